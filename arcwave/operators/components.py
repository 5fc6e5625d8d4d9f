"""Connected components of an undirected link table, by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcwave.plans.lineage import Table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _written(edges: DataFrame) -> tuple[Table, tuple[int, int]]:
    """The links as a table, and their number and sum of hashes, observed while they are written."""
    seen = Observation()
    # a decimal sum can't overflow, and doesn't depend on the order of rows
    table = Table(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
    return table, (seen.get["n"], int(seen.get["h"] or 0))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64, ready: bool = False) -> DataFrame:
    """(node, component) for every node that has a link to another one; component = its smallest reachable node.

    Each round is two shuffles of the links and O(log n) rounds are usual. Nulls and self-links are
    dropped. A hub's links meet its minimum by a join that adaptive execution can split. ``ready`` says that ``links`` is
    a written table with few repeats, so that the first round reads it as it is.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")  # nulls fall out here
    start = both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    now, state = (None, None) if ready else _written(start.distinct())
    for _ in range(max_rounds):
        if state and not state[0]:
            break
        before = state
        new, state = _written(_small_star(_large_star(now.df if now else start)))
        if now:
            now.drop()
        now = new
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
