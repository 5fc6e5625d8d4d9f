"""Removal of lines that many documents share, with two Bloom filters in front of the exact check.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. Keys of ``MIN_CHARS`` code points or more that
``MIN_DOCS`` documents hold lose all their lines but those of the document with the largest id.

1. Each task hashes the keys of its lines, once a document, and sends every hash once, marked if several of its documents have it, to the
   block of the hash space that it is in. Blocks get some ``BLOCK_KEYS`` keys whatever the input is. A block puts hashes into the
   filter of once-seen ones; a hash that is there already goes into the filter of twice-seen ones. The first filter never leaves its task.
2. Lines are tested against the second filter, and only suspects shuffle: the SHA-256 of their key and their document. Counting these
   is exact, and so is the choice of the document that keeps the line. A filter errs on one side only, so no repeat is missed.
3. Documents lose the lines whose key is among the confirmed ones.

The filters of twice-seen hashes are broadcast up to ``FILTER_BYTES``, and the confirmed keys up to ``BROADCAST_KEYS`` rows, both counted
first. Beyond, hashes are joined to the twice-seen ones by shuffle, and documents to their lists of lines that go.

Null and empty texts are one empty line. A row without an id isn't a document that could keep a line: its lines count for no key and all
stay. Rows that repeat an id are one document, so they keep or lose the same lines. Texts and lines of any length are handled whole. Ties can't
happen, as ids are compared. An empty table gives no rows. Columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.textkit import LOWER, SEPARATOR, U64, mix, powers, text_chunks
from arcwave.plans.lineage import cut

MIN_CHARS = 20
MIN_DOCS = 3
BLOCK_KEYS = 1_000_000
TASK_HASHES = 4_000_000
BITS_A_KEY = 12
PROBES = 6
FILTER_BYTES = 64 << 20
BROADCAST_KEYS = 400_000

_VALUE = (LOWER + 1).astype(np.uint64)


class Lines:
    """The lines of some texts: byte ranges of lines and of their stripped keys, and each text's first line."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        self.buf, breaks = buf, np.flatnonzero(buf == 10)
        before = np.searchsorted(breaks, off)
        texts = np.arange(len(off))
        self.first = before - before[0] + texts
        total = int(self.first[-1])
        self.end = np.zeros(total, np.int64)
        last = self.first[1:] - 1
        inner = np.ones(total, bool)
        inner[last] = False
        self.end[last], self.end[inner] = off[1:], breaks
        self.start = np.empty(total, np.int64)
        self.start[1:] = self.end[:-1] + 1
        self.start[self.first[:-1]] = off[:-1]
        solid = np.flatnonzero(~SEPARATOR[buf])
        a, b = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = a < b
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[some], self.key_end[some] = solid[a[some]], solid[b[some] - 1] + 1
        self.text = np.repeat(texts[:-1], np.diff(self.first))

    def long(self, min_chars: int) -> np.ndarray:
        """The lines whose key has ``min_chars`` code points or more."""
        points = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        return np.flatnonzero(points[self.key_end] - points[self.key_start] >= min_chars)

    def hashes(self, lines: np.ndarray) -> np.ndarray:
        """64-bit hashes of the keys of some (ascending, nonempty) lines."""
        if not len(lines):
            return np.zeros(0, np.uint64)
        start, end = self.key_start[lines], self.key_end[lines]
        size = end - start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        value = _VALUE[self.buf[place + np.repeat(start, size)]]
        value *= powers(int(size.max()) + 1)[place]
        return mix(np.add.reduceat(value, begin))

    def digest(self, line: int) -> bytes:
        return sha256(LOWER[self.buf[self.key_start[line] : self.key_end[line]]].astype(np.uint8).tobytes()).digest()


class Bloom:
    """``1 << bits`` bits at ``base`` of a shared array; probes are taken from the two halves of a mixed hash."""

    def __init__(self, keys: int) -> None:
        self.bits = max(6, int(keys * BITS_A_KEY - 1).bit_length())
        self.held = np.zeros(1 << self.bits, bool)

    def add(self, hashes: np.ndarray) -> None:
        for at in probes(hashes, np.uint64(self.bits)):
            self.held[at] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in probes(hashes, np.uint64(self.bits)):
            found &= self.held[at]
        return found


def probes(hashes: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    mask = (U64(1) << bits) - U64(1)
    again = mix(hashes)
    step = (again >> U64(32)) | U64(1)
    for k in range(PROBES):
        yield ((again + U64(k) * step) & mask).astype(np.int64)


class Suspects:
    """The filters of twice-seen hashes of all blocks, as one array of packed bits."""

    def __init__(self, parts: int, rows: list[tuple[int, int, bytes]]) -> None:
        """``rows`` are (block, bits, packed filter); blocks without a row have no repeats."""
        self.parts = parts
        self.bits, self.base = np.zeros(1 << parts, np.uint64), np.full(1 << parts, -1, np.int64)
        at, packed = 0, []
        for block, bits, data in rows:
            self.bits[block], self.base[block] = bits, at
            packed.append(np.frombuffer(data, np.uint8))
            at += 8 * len(data)
        self.packed = np.concatenate([np.zeros(0, np.uint8), *packed])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block = block_of(hashes, self.parts)
        found = self.base[block] >= 0
        for at in probes(hashes, self.bits[block]):
            bit = np.where(found, at + self.base[block], 0)
            found = found & ((self.packed[bit >> 3] >> (bit & 7)).astype(np.uint8) & 1 == 1) if len(self.packed) else found & False
        return found


def block_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> U64(64 - parts)).astype(np.int64) if parts else np.zeros(len(hashes), np.int64)


def twice_seen(t: pa.Table) -> pa.Table:
    """One block's (block, bits, filter, hashes): the filter of the hashes that at least two documents have, and these (some of them by the filter's error)."""
    rows = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(t.column("once").to_pylist(), t.column("more").to_pylist(), strict=True)]
    once = Bloom(sum(len(a) + len(b) for a, b in rows))
    met = [np.zeros(0, np.uint64)]
    for single, many in rows:
        met += [many, single[once.has(single)]]
        once.add(single)
        once.add(many)
    met = np.unique(np.concatenate(met))
    twice = Bloom(len(met))
    twice.add(met)
    n = 1 if len(met) else 0
    return pa.table({"block": t.column("block")[:n], "bits": pa.array([twice.bits] * n, pa.int32()), "filter": pa.array([np.packbits(twice.held, bitorder="little").tobytes()] * n, pa.binary()), "hashes": pa.array([met.astype(np.int64)] * n, pa.list_(pa.int64()))})


def _hashed(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[pa.Array, Lines, np.ndarray, np.ndarray]]:
    """(ids of the texts, lines, the long ones of texts with an id, their hashes) of a batch (id, text), some texts at a time."""
    for first, end, buf, off in text_chunks(batch.column(1)):
        lines, ids = Lines(buf, off), batch.column(0).slice(first, end - first)
        long = lines.long(min_chars)
        if ids.null_count:
            long = long[ids.is_valid().to_numpy(zero_copy_only=False)[lines.text[long]]]
        yield ids, lines, long, lines.hashes(long)


def _once_a_text(lines: Lines, long: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in ``long``, one for each text and hash."""
    order = np.lexsort((hashes, lines.text[long]))
    h, d = hashes[order], lines.text[long][order]
    return order[np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1])])]


def repeated_lines(rows: DataFrame, kind: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """From (id, text): (digest, hash, id) of all lines that may repeat, once a document, and (digest, hash, keep) of the keys of ``min_docs`` documents, ``keep`` the largest id."""
    if min_docs < 2:
        raise ValueError("a repeat takes two documents")
    spark = rows.sparkSession
    # a key takes min_chars bytes and its line one more, so there are at most this many
    keys = rows.agg(F.sum(F.floor(F.octet_length("text") / (min_chars + 1)) + 1)).first()[0] or 1
    parts = max(0, int(-(-int(keys) // BLOCK_KEYS) - 1).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            block = block_of(h, parts)
            blocks, start = np.unique(block, return_index=True)
            pieces = [slice(a, b) for a, b in zip(start, np.append(start, len(h))[1:], strict=True)]
            return pa.RecordBatch.from_pydict({
                "block": pa.array(blocks, pa.int64()),
                "once": pa.array([h[s][n[s] == 1].tobytes() for s in pieces], pa.binary()),
                "more": pa.array([h[s][n[s] > 1].tobytes() for s in pieces], pa.binary()),
            })

        for b in batches:
            for _, lines, long, hashes in _hashed(b, min_chars):
                held.append(hashes[_once_a_text(lines, long, hashes)])
                size += len(held[-1])
                if size >= TASK_HASHES:
                    yield flush()
                    held, size = [], 0
        yield flush()

    sent = rows.mapInArrow(send, "block bigint, once binary, more binary")
    seen = cut(sent.groupBy("block").applyInArrow(twice_seen, "block bigint, bits int, filter binary, hashes array<bigint>"))
    narrow = (seen.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= filter_bytes
    filters = spark.sparkContext.broadcast(Suspects(parts, [tuple(r) for r in seen.select("block", "bits", "filter").orderBy("block").collect()])) if narrow else None

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lines, long, hashes in _hashed(b, min_chars):
                at = _once_a_text(lines, long, hashes)
                at = at[filters.value.has(hashes[at])] if filters else at
                digests = pa.array([lines.digest(k) for k in long[at]], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(hashes[at].view(np.int64)), ids.take(pa.array(lines.text[long[at]]))], ["digest", "hash", "id"])

    suspects = rows.mapInArrow(suspect, f"digest binary, hash bigint, id {kind}")
    if not narrow:
        suspects = suspects.join(seen.select(F.explode("hashes").alias("hash")), "hash", "left_semi").select("digest", "hash", "id")
    pairs = cut(suspects.distinct())
    counted = pairs.groupBy("digest", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    return pairs, cut(counted.filter(F.col("n") >= min_docs).select("digest", "hash", "keep"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(id, text, n_lines bigint, n_dropped bigint) for every row: the text without its repeated lines; a null text is an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pairs, confirmed = repeated_lines(rows, kind, min_chars, min_docs, filter_bytes)
    out = f"id {kind}, text string, n_lines bigint, n_dropped bigint"
    if confirmed.count() <= broadcast_keys:
        held = confirmed.orderBy("hash").toArrow()
        value = (held.column("hash").to_numpy(), held.column("digest").to_pylist(), held.column("keep").to_pylist())
        known = rows.sparkSession.sparkContext.broadcast(value)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, digests, keeps = known.value
            for b in batches:
                for ids, lines, long, hashes in _hashed(b, min_chars):
                    signed = hashes.view(np.int64)
                    low, high = np.searchsorted(order, signed), np.searchsorted(order, signed, "right")
                    names = ids.to_pylist()
                    gone = np.zeros(len(lines.start), bool)
                    for k in np.flatnonzero(low < high):
                        line = long[k]
                        name, digest = names[lines.text[line]], lines.digest(line)
                        gone[line] = any(digests[j] == digest and keeps[j] != name for j in range(low[k], high[k]))
                    yield _without(ids, lines, gone)

        return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
    lost = pairs.join(confirmed, ["digest", "hash"]).filter("id <> keep").groupBy("id").agg(F.collect_list("digest").alias("gone"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for ids, lines, long, _ in _hashed(b, min_chars):
                sets: list[Any] = [set(x) if x else None for x in b.column(2).slice(at, len(ids)).to_pylist()]
                at += len(ids)
                gone = np.zeros(len(lines.start), bool)
                for line in long:
                    of = sets[lines.text[line]]
                    gone[line] = of is not None and lines.digest(line) in of
                yield _without(ids, lines, gone)

    return rows.join(lost, "id", "left").select("id", "text", "gone").mapInArrow(listed, out).withColumnRenamed("id", id_col)


def _without(ids: pa.Array, lines: Lines, gone: np.ndarray) -> pa.RecordBatch:
    """(id, text, n_lines, n_dropped) without the lines that are ``gone``."""
    sums = np.concatenate([[0], np.cumsum(gone)])
    dropped = np.diff(sums[lines.first])
    texts = []
    for k, (first, end) in enumerate(zip(lines.first[:-1].tolist(), lines.first[1:].tolist(), strict=True)):
        if dropped[k]:
            texts.append(b"\n".join(lines.buf[lines.start[j] : lines.end[j]].tobytes() for j in range(first, end) if not gone[j]))
        else:
            texts.append(lines.buf[lines.start[first] : lines.end[end - 1]].tobytes())
    return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(lines.first), pa.int64()), pa.array(dropped, pa.int64())], ["id", "text", "n_lines", "n_dropped"])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
with lines as materialized (
  select doc_id, unnest(cut) line, generate_subscripts(cut, 1) pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) cut from documents)
), keyed as materialized (
  select *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from lines
), shared as materialized (
  select key, max(doc_id) keep from keyed where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS}
), judged as (
  select doc_id, pos, line, keep is not null and doc_id is not null and keep <> doc_id gone from keyed left join shared using (key)
)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from judged group by doc_id
"""
