"""Joins whose one side may hold a key in a large share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwave.plans.lineage import cut

TASK_ROWS = 20_000
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; give it a written table of narrow rows, as it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


def spread_join(big: DataFrame, other: DataFrame, on: list[str], by: str, how: str = "inner", task_rows: int = TASK_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``big.join(other, on, how)``; keys with over ``task_rows`` rows in ``big`` are dealt over tasks by the hash of ``by``.

    ``other``'s rows of such keys are repeated once a task. The heavy keys are counted with map-side combination and are at
    most ``big``'s rows / ``task_rows``. ``counts`` (on, n) spares that count, where it is known; else ``big`` is read twice, so
    it should be a written table.
    """
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    heavy = cut(counts.filter(F.col("n") > task_rows).select(*on, F.ceil(F.col("n") / task_rows).cast("int").alias("__parts")))
    if heavy.isEmpty():
        return big.join(other, on, how)
    heavy = small(heavy)
    parts = F.coalesce("__parts", F.lit(1))
    left = big.join(heavy, on, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = other.join(heavy, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*on, "__part"], how).drop("__part")
