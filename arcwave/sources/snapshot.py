"""Portable byte snapshots of a graph's forward rows.

A snapshot is an 80-byte header, V + 1 offsets and E targets, all little-endian. ``snapshot_chunks`` makes it as an
ordered table of byte chunks of bounded size, so a large graph never meets in one row; ``encode_snapshot`` joins them
for a graph that fits; ``decode_chunks`` reads the table in tasks. Decoding checks every gate in a fixed order before it builds anything.
"""

from __future__ import annotations

import hmac
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.errors import SnapshotError
from arcwave.functions.blake3 import CHUNK, context_key, derive_key, material_part, merged_parts
from arcwave.graph import FORWARD, U32_MAX, Graph, running_sum
from arcwave.plans.lineage import cut
from arcwave.sources.parts import Rows, from_parts

# Fixed values of the format.
MAGIC = bytes.fromhex("4c5647534e500001")
SCHEMA_ID = b"LVGI-CSR-FWD-V1!"
VERSION = (1, 0)
HEADER_BYTES = 80
_HEADER = struct.Struct("<8s16sHHI32sIIQ")

CHUNK_WORDS = 65_536
INLINE_BYTES = 256 << 20
PART_CHUNKS = 1024  # hash chunks of 1 KB that one task call hashes; a power of two
FAN = 1024  # values that one task call merges; a power of two


@dataclass(frozen=True)
class SnapshotLimits:
    max_vertices: int = U32_MAX
    max_edges: int = U32_MAX
    max_bytes: int = 2**64 - 1

    @staticmethod
    def unbounded() -> SnapshotLimits:
        return SnapshotLimits()


def payload_length(vertices: int, edges: int) -> int:
    return 4 * (vertices + 1 + edges)


def snapshot_length(vertices: int, edges: int) -> int:
    return HEADER_BYTES + payload_length(vertices, edges)


def decode_work_bound(vertices: int, edges: int) -> int:
    return 10 + 4 * vertices + 3 * edges


def decode_heap_words(vertices: int, edges: int) -> int:
    return 2 * vertices + 1 + edges


def header(vertices: int, edges: int, profile: bytes) -> bytes:
    _require_profile(profile)
    return _HEADER.pack(MAGIC, SCHEMA_ID, *VERSION, 0, profile, vertices, edges, payload_length(vertices, edges))


def _require_profile(profile: bytes) -> None:
    if len(profile) != 32:
        raise ValueError("a profile has 32 bytes")


def snapshot_chunks(graph: Graph, profile: bytes, words: int = CHUNK_WORDS) -> DataFrame:
    """(chunk, bytes): the header as chunk 0, then the payload, ``words`` words a chunk."""
    payload = graph.offsets(FORWARD).select("pos", F.col("offset").alias("word")).unionByName(graph.targets(FORWARD).select((F.col("pos") + graph.vertex_count + 1).alias("pos"), F.col("target").alias("word")))
    big = F.lpad(F.hex("word"), 8, "0")
    little = F.concat(*[F.substring(big, k, 2) for k in (7, 5, 3, 1)])
    cells = payload.select((F.expr(f"pos div {words}") + 1).alias("chunk"), F.struct("pos", little.alias("hex")).alias("cell"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda x: x["hex"]), "")
    body = cells.groupBy("chunk").agg(F.unhex(joined).alias("bytes"))
    first = graph.edges.sparkSession.createDataFrame([(0, bytearray(header(graph.vertex_count, graph.edge_count, profile)))], "chunk bigint, bytes binary")
    return first.unionByName(body)


def encode_snapshot(graph: Graph, profile: bytes) -> bytes:
    size = snapshot_length(graph.vertex_count, graph.edge_count)
    if size > INLINE_BYTES:
        raise ValueError(f"{size} bytes are over {INLINE_BYTES}; write snapshot_chunks instead")
    return b"".join(bytes(r["bytes"]) for r in snapshot_chunks(graph, profile).orderBy("chunk").collect())


def admit(data: bytes, profile: bytes, limits: SnapshotLimits) -> tuple[int, int]:
    """The counts of a snapshot whose header and length pass every gate."""
    return _admit(data, len(data), profile, limits)


def _admit(data: bytes, total: int, profile: bytes, limits: SnapshotLimits) -> tuple[int, int]:
    """The same of a snapshot of ``total`` bytes that begins with ``data``."""
    _require_profile(profile)

    def gate(good: bool, kind: str) -> None:
        if not good:
            raise SnapshotError(kind)

    gate(len(data) >= HEADER_BYTES, "HeaderTruncated")
    magic, schema, major, minor, flags, own, vertices, edges, length = _HEADER.unpack_from(data)
    gate(magic == MAGIC, "Magic")
    gate(schema == SCHEMA_ID, "Schema")
    gate((major, minor) == VERSION, "Version")
    gate(flags == 0, "Flags")
    gate(own == profile, "Profile")
    gate(vertices <= limits.max_vertices, "VertexLimit")
    gate(edges <= limits.max_edges, "EdgeLimit")
    gate(total <= limits.max_bytes, "ByteLimit")
    gate(length == payload_length(vertices, edges), "PayloadLength")
    gate(total >= HEADER_BYTES + length, "Truncated")
    gate(total == HEADER_BYTES + length, "Trailing")
    return vertices, edges


def decode_snapshot(spark: SparkSession, data: bytes, profile: bytes, limits: SnapshotLimits | None = None) -> Graph:
    """The graph of a snapshot, over dense keys and without a reverse; errors are SnapshotError or those of the rows."""
    vertices, edges = admit(data, profile, limits or SnapshotLimits())
    step = 4 * CHUNK_WORDS
    chunks = [(at // 4, bytearray(data[HEADER_BYTES + at : HEADER_BYTES + at + step])) for at in range(0, payload_length(vertices, edges), step)]
    return _decoded(spark.createDataFrame(chunks, "at bigint, part binary"), vertices)


def decode_chunks(chunks: DataFrame, profile: bytes, limits: SnapshotLimits | None = None) -> Graph:
    """The graph of what ``snapshot_chunks`` made: (chunk, bytes), the header in chunk 0 and whole words in the others.

    The driver sees the header and the number of bytes; words are read in tasks, a chunk at a time.
    """
    head = chunks.filter("chunk = 0").select("bytes").first()
    total = chunks.agg(F.sum(F.length("bytes"))).first()[0] or 0
    vertices, _ = _admit(bytes(head["bytes"]) if head else b"", total, profile, limits or SnapshotLimits())
    body = chunks.filter("chunk > 0")
    if not body.filter("length(bytes) % 4 <> 0").isEmpty():
        raise SnapshotError("Truncated")
    sized = running_sum(body.select("chunk", (F.length("bytes") / 4).cast("bigint").alias("words")), "chunk", "words", "end")
    placed = body.join(sized.select("chunk", (F.col("end") - F.col("words")).alias("at")), "chunk")
    return _decoded(placed.select("at", F.col("bytes").alias("part")), vertices)


def _decoded(parts: DataFrame, vertices: int) -> Graph:
    """The graph of payload parts (at, part), each from word ``at``."""
    spark = parts.sparkSession

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values = np.frombuffer(part, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), pa.array(values)], ["pos", "word"])

    cells = parts.mapInArrow(words, "pos bigint, word bigint")
    offsets = cells.filter(F.col("pos") <= vertices).select("pos", F.col("word").alias("offset"))
    targets = cells.filter(F.col("pos") > vertices).select((F.col("pos") - vertices - 1).alias("pos"), F.col("word").alias("target"))
    nodes = spark.range(vertices).select(F.col("id").alias("pos"), F.col("id").alias("stable"))
    return from_parts(nodes, Rows(offsets, targets))


def digest_snapshot(data: bytes, profile: bytes, context: str) -> bytes:
    """BLAKE3 in key-derivation mode over schema, profile, length and bytes; ``context`` names the application that both sides agreed on."""
    _require_profile(profile)
    return derive_key(context, SCHEMA_ID + profile + struct.pack("<Q", len(data)) + data)


def decode_verified_snapshot(spark: SparkSession, data: bytes, profile: bytes, digest: bytes, context: str, limits: SnapshotLimits | None = None) -> Graph:
    """Byte limit, then digest, then structure."""
    limits = limits or SnapshotLimits()
    if len(data) > limits.max_bytes:
        raise SnapshotError("ByteLimit")
    if not hmac.compare_digest(digest_snapshot(data, profile, context), digest):
        raise SnapshotError("Digest")
    return decode_snapshot(spark, data, profile, limits)


def digest_chunks(chunks: DataFrame, profile: bytes, context: str, part_chunks: int = PART_CHUNKS, fan: int = FAN) -> bytes:
    """``digest_snapshot`` of what ``snapshot_chunks`` made, whatever the size of its chunks.

    The hash is a tree: bytes are dealt to aligned parts of 1 MB, each hashed to 32 bytes by itself, and runs of values are merged
    level by level in tasks. The driver sees the length and at most ``fan`` values.
    """
    _require_profile(profile)
    key, size = context_key(context), CHUNK * part_chunks
    rows = chunks.select("chunk", "bytes", F.length("bytes").cast("bigint").alias("n")).filter("n > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    prefix = SCHEMA_ID + profile + struct.pack("<Q", total)
    ends = running_sum(rows.select("chunk", "n"), "chunk", "n", "end").select("chunk", (F.col("end") - F.col("n") + len(prefix)).alias("at"))
    first = chunks.sparkSession.createDataFrame([(0, bytearray(prefix), len(prefix))], "at bigint, bytes binary, n bigint")
    placed = rows.join(ends, "chunk").select("at", "bytes", "n").unionByName(first)
    spread = placed.withColumn("part", F.explode(F.sequence(F.expr(f"at div {size}"), F.expr(f"(at + n - 1) div {size}"))))
    low = F.greatest(F.col("part") * size - F.col("at"), F.lit(0))
    high = F.least((F.col("part") + 1) * size - F.col("at"), F.col("n"))
    pieces = spread.select("part", (F.col("at") + low).alias("at"), F.substring("bytes", (low + 1).cast("int"), (high - low).cast("int")).alias("bytes"))
    count = -(-(total + len(prefix)) // size)

    def hashed(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        part = t.column("part")[0].as_py()
        return pa.table({"part": [part], "value": [material_part(b"".join(t.column("bytes").to_pylist()), key, part * part_chunks, count == 1)]})

    def merged(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"part": [t.column("part")[0].as_py() // fan], "value": [merged_parts(t.column("value").to_pylist(), key, False)]})

    values = cut(pieces.groupBy("part").applyInArrow(hashed, "part bigint, value binary"))
    while count > fan:
        values = cut(values.groupBy(F.expr(f"part div {fan}")).applyInArrow(merged, "part bigint, value binary"))
        count = -(-count // fan)
    top = [bytes(r["value"]) for r in values.orderBy("part").collect()]
    return top[0] if count == 1 else merged_parts(top, key, True)


def decode_verified_chunks(chunks: DataFrame, profile: bytes, digest: bytes, context: str, limits: SnapshotLimits | None = None) -> Graph:
    """``decode_verified_snapshot`` of chunks: byte limit, then digest, then structure, all in tasks."""
    limits = limits or SnapshotLimits()
    if (chunks.agg(F.sum(F.length("bytes"))).first()[0] or 0) > limits.max_bytes:
        raise SnapshotError("ByteLimit")
    if not hmac.compare_digest(digest_chunks(chunks, profile, context), digest):
        raise SnapshotError("Digest")
    return decode_chunks(chunks, profile, limits)


Decoder = Callable[[DataFrame, bytes, SnapshotLimits | None], Graph]
Encoder = Callable[[Graph, bytes], DataFrame]
#: Decoders of the known schemas, by identity and version; a later schema adds its own.
DECODERS: dict[tuple[bytes, tuple[int, int]], Decoder] = {(SCHEMA_ID, VERSION): decode_chunks}


def migrate_chunks(chunks: DataFrame, profile: bytes, new_profile: bytes, encode: Encoder = snapshot_chunks, decoders: dict[tuple[bytes, tuple[int, int]], Decoder] | None = None, limits: SnapshotLimits | None = None) -> DataFrame:
    """Chunks of ``encode`` for the graph of ``chunks``: old bytes, a validated graph, new bytes.

    The schema and version that the header names choose the decoder. Bytes of a schema or version without one are refused and never
    reach the encoder.
    """
    known = DECODERS if decoders is None else decoders
    head = chunks.filter("chunk = 0").select("bytes").first()
    data = bytes(head["bytes"]) if head else b""
    if len(data) < HEADER_BYTES:
        raise SnapshotError("HeaderTruncated")
    magic, schema, major, minor = _HEADER.unpack_from(data)[:4]
    if magic != MAGIC:
        raise SnapshotError("Magic")
    if schema not in {s for s, _ in known}:
        raise SnapshotError("Schema")
    if (schema, (major, minor)) not in known:
        raise SnapshotError("Version")
    return encode(known[schema, (major, minor)](chunks, profile, limits), new_profile)
