"""The binary snapshot format as a Spark data source: ``spark.read.format("arcwave_snapshot")`` and ``df.write.format("arcwave_snapshot")``.

A snapshot is a folder whose part files, one behind the other in the order of their names, are its bytes: the 80-byte header, then little-endian
words. It is written from a table (pos, word), the words of the payload, each partition a range of positions in ascending order
(``payload_words`` makes it). A task writes its range to a file of its attempt's own name and reports the range. Only the commit, when all tasks
have reported, checks that the ranges join up, writes the header and the list of files; a snapshot without the list is none, so
readers see all or nothing, and files of failed attempts are never listed. An abort deletes what was reported.

Reading gives (pos, word). Partitions are byte ranges of ``bytes_a_task``, whatever the files' sizes; the header's gates are checked
once, on the driver, which sees 80 bytes and the list. Files are reached through pyarrow's file systems by the path's scheme.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from arcwave.errors import SnapshotError
from arcwave.graph import FORWARD, Graph
from arcwave.sources.parts import Rows, from_parts
from arcwave.sources.snapshot import HEADER_BYTES, SnapshotLimits, _admit, header

NAME = "arcwave_snapshot"
LIST = "parts.json"
SCHEMA = "pos bigint, word bigint"
BYTES_A_TASK = 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)


@dataclass
class Range(InputPartition):
    """Words ``first`` to ``end`` as (file, first byte, length)."""

    first: int
    pieces: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    words: int


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(options.get("bytes_a_task", BYTES_A_TASK)) // 4 * 4
        if self.step <= 0:
            raise ValueError("bytes_a_task is at least 4")
        files, root = _opened(self.path)
        if files.get_file_info(f"{root}/{LIST}").type != fs.FileType.File:
            raise SnapshotError("HeaderTruncated")
        with files.open_input_stream(f"{root}/{LIST}") as f:
            self.parts = json.loads(f.read())
        names = [p["name"] for p in self.parts]
        sizes = [i.size or 0 for i in files.get_file_info([f"{root}/{n}" for n in names])]
        with files.open_input_stream(f"{root}/{names[0]}") as f:
            head = f.read(HEADER_BYTES)
        limits = SnapshotLimits(**{k: int(options[k]) for k in ("max_vertices", "max_edges", "max_bytes") if k in options})
        self.vertices, self.edges = _admit(head, sum(sizes), bytes.fromhex(options["profile"]), limits)
        self.sizes = list(zip(names[1:], sizes[1:], strict=True))

    def partitions(self) -> list[Range]:
        out, at, room = [], 0, 0
        for name, size in self.sizes:
            done = 0
            while done < size:
                if not room:
                    out.append(Range(at // 4, []))
                    room = self.step
                take = min(room, size - done)
                out[-1].pieces.append((name, done, take))
                done, at, room = done + take, at + take, room - take
        return out or [Range(0, [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.path)
        at = partition.first
        for name, start, length in partition.pieces:
            with files.open_input_file(f"{root}/{name}") as f:
                words = np.frombuffer(f.read_at(length, start), "<u4").astype(np.int64)
            for k in range(0, len(words), 1 << 16):
                part = words[k : k + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(at + k, at + k + len(part))), "word": pa.array(part)})
            at += len(words)


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.head = header(int(options["vertices"]), int(options["edges"]), bytes.fromhex(options["profile"]))
        self.words = int(options["vertices"]) + 1 + int(options["edges"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        name, first, count, out = f"part-{uuid.uuid4().hex}.bin", -1, 0, None
        for batch in iterator:
            pos, word = batch.column("pos").to_numpy(), batch.column("word").to_numpy()
            if not len(pos):
                continue
            if out is None:
                first, out = int(pos[0]), files.open_output_stream(f"{root}/{name}")
            if (pos != np.arange(first + count, first + count + len(pos))).any() or (word < 0).any() or (word >> 32).any():
                raise ValueError("a partition of a snapshot is a range of positions in ascending order, and words have 32 bits")
            out.write(word.astype("<u4").tobytes())
            count += len(pos)
        if out is not None:
            out.close()
        return Written(name, first, count)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        held = sorted((m for m in messages if m is not None and m.words), key=lambda m: m.first)
        at = 0
        for m in held:
            if m.first != at:
                raise ValueError(f"word {at} is missing or given twice")
            at += m.words
        if at != self.words:
            raise ValueError(f"{at} words in place of {self.words}")
        listed = f"{root}/{LIST}"
        if files.get_file_info(listed).type == fs.FileType.File and not self.overwrite:
            raise FileExistsError(self.path)
        head = f"head-{uuid.uuid4().hex}.bin"
        with files.open_output_stream(f"{root}/{head}") as f:
            f.write(self.head)
        parts = [{"name": head, "bytes": HEADER_BYTES}, *({"name": m.name, "bytes": 4 * m.words} for m in held)]
        with files.open_output_stream(f"{listed}.new") as f:
            f.write(json.dumps(parts).encode())
        files.move(f"{listed}.new", listed)  # from here on the snapshot is there

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        for m in messages:
            if m is not None and m.words:
                files.delete_file(f"{root}/{m.name}")


class SnapshotSource(DataSource):
    """Options: ``path``, ``profile`` (hex of 32 bytes); for writing ``vertices`` and ``edges``; for reading the limits and ``bytes_a_task``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> SnapshotReader:
        return SnapshotReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(dict(self.options), overwrite)


def payload_words(graph: Graph) -> DataFrame:
    """(pos, word): offsets, then targets; partitions are ranges of positions in ascending order."""
    words = graph.offsets(FORWARD).select("pos", F.col("offset").alias("word"))
    words = words.unionByName(graph.targets(FORWARD).select((F.col("pos") + graph.vertex_count + 1).alias("pos"), F.col("target").alias("word")))
    return words.repartitionByRange("pos").sortWithinPartitions("pos")


def write_snapshot(graph: Graph, path: str, profile: bytes, overwrite: bool = False) -> None:
    graph.edges.sparkSession.dataSource.register(SnapshotSource)
    out = payload_words(graph).write.format(NAME).option("profile", profile.hex()).option("vertices", graph.vertex_count).option("edges", graph.edge_count)
    out.mode("overwrite" if overwrite else "append").save(path)


def read_snapshot(spark: SparkSession, path: str, profile: bytes, limits: SnapshotLimits | None = None, bytes_a_task: int = BYTES_A_TASK) -> Graph:
    """The graph of a snapshot folder; errors are SnapshotError or those of the rows."""
    spark.dataSource.register(SnapshotSource)
    options = {"path": path, "profile": profile.hex(), "bytes_a_task": str(bytes_a_task)}
    limits = limits or SnapshotLimits()
    options |= {k: str(getattr(limits, k)) for k in ("max_vertices", "max_edges", "max_bytes")}
    vertices = SnapshotReader(options).vertices
    words = spark.read.format(NAME).options(**options).load()
    offsets = words.filter(F.col("pos") <= vertices).select("pos", F.col("word").alias("offset"))
    targets = words.filter(F.col("pos") > vertices).select((F.col("pos") - vertices - 1).alias("pos"), F.col("word").alias("target"))
    nodes = spark.range(vertices).select(F.col("id").alias("pos"), F.col("id").alias("stable"))
    return from_parts(nodes, Rows(offsets, targets))
