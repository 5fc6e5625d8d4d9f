"""Packing into optimal length buckets.

The histogram of text lengths over all rows is exact and small (one row per distinct length). Dynamic
programming over it picks at most ``buckets`` upper bounds with the least padding: the best split is a
lower envelope of lines, so it takes one sweep per bucket. Inside a bucket with bound b, rows are
numbered in a global order and every ``budget // b`` of them make a batch (at least one), so a
padded batch never holds more than ``budget`` tokens unless a single text does.

A text's length is its number of white-space words plus one end token; null and empty texts have
length 1. Rows with equal ids are interchangeable; null ids sort first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.textkit import text_chunks, word_spans
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import cut

BUDGET = 16_384
BUCKETS = 12


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens bigint): words plus one, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.zeros(0, np.int64)] + [np.diff(word_spans(buf, off)[2]) for _, _, buf, off in text_chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(counts) + 1, pa.int64())], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Ascending upper bounds, at most ``buckets``, of least total padding for (length, count) pairs. Ties go to fewer buckets."""
    histogram = sorted((int(n), int(c)) for n, c in histogram if c > 0)
    if not histogram:
        return []
    lengths = [n for n, _ in histogram]
    rows, words = [0], [0]
    for n, c in histogram:
        rows.append(rows[-1] + c)
        words.append(words[-1] + n * c)
    size = len(lengths)
    # cost[j]: padding of the first j lengths. A bucket over lengths i..j-1 adds bound * (rows[j] - rows[i]) - (words[j] - words[i])
    cost: list[int | None] = [0] + [None] * size
    back: list[list[int]] = []
    best, chosen = None, 0
    for k in range(1, min(buckets, size) + 1):
        new: list[int | None] = [None] * (size + 1)
        origin = [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []  # lines of falling slope -rows[i] with intercept cost[i] + words[i]
        front = 0
        for j in range(1, size + 1):
            i = j - 1
            if cost[i] is not None:
                m, c = -rows[i], cost[i] + words[i]
                while len(hull) - front >= 2 and _covered(hull[-2], hull[-1], (m, c, i)):
                    hull.pop()
                hull.append((m, c, i))
            if front >= len(hull):
                continue
            x = lengths[j - 1]
            while front + 1 < len(hull) and hull[front + 1][0] * x + hull[front + 1][1] <= hull[front][0] * x + hull[front][1]:
                front += 1
            m, c, i = hull[front]
            new[j], origin[j] = m * x + c + x * rows[j] - words[j], i
        back.append(origin)
        cost = new
        if best is None or cost[size] < best:
            best, chosen = cost[size], k
    bounds, j = [], size
    for k in range(chosen, 0, -1):
        bounds.append(lengths[j - 1])
        j = back[k - 1][j]
    return bounds[::-1]


def _covered(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(lengths: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, bucket int, bucket_len, batch, slot, padding) from (id, n_tokens): batches are numbered from 0 over all buckets, slots from 0 in a batch."""
    histogram = [(r["n_tokens"], r["n"]) for r in lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()]
    bounds = optimal_bounds(histogram, buckets)
    sizes, at = [0] * len(bounds), 0
    for n, c in sorted(histogram):
        while n > bounds[at]:
            at += 1
        sizes[at] += c
    room = [max(1, budget // b) for b in bounds]
    rows_before = [sum(sizes[:k]) for k in range(len(bounds))]
    batches_before = [sum(-(-s // r) for s, r in zip(sizes[:k], room, strict=False)) for k in range(len(bounds))]
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values] or [F.lit(None).cast("bigint")]), F.col("bucket") + 1)
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    placed = global_rank(lengths.withColumn("bucket", bucket), [F.col("bucket"), F.col(id_col), F.col("n_tokens")], "rank")
    inside = F.col("rank") - pick(rows_before)
    return placed.select(
        id_col, "n_tokens", "bucket", pick(bounds).alias("bucket_len"),
        (pick(batches_before) + (inside - inside % pick(room)) / pick(room)).cast('bigint').alias("batch"),
        (inside % pick(room)).alias("slot"), (pick(bounds) - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(cut(word_lengths(docs, id_col, text_col)), budget, buckets, id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
