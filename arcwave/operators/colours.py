"""Colour refinement: what a graph looks like whatever its vertices are called.

Every vertex starts with one colour, and in each round takes the hash of its colour and of the multisets of its successors' and
predecessors' colours. Multisets are marked by the sum of their members' digests, so no list is sorted or collected, and a hub is a partial sum
in every task. Renaming vertices changes no colour, so the histogram of colours is the same for a graph and all its renamings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwave.graph import Graph
from arcwave.operators.scc import Decomposition
from arcwave.plans.lineage import Table

ROUNDS = 4


def _mark(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("decimal(38,0)")


def refined(graph: Graph, rounds: int = ROUNDS) -> DataFrame:
    """(dense, colour) after ``rounds`` rounds, written."""
    now = Table(graph.vertices.select("dense", F.lit("").alias("colour")))
    for _ in range(rounds):
        side = lambda own, other, name: graph.edges.join(now.df.select(F.col("dense").alias(other), "colour"), other).groupBy(F.col(own).alias("dense")).agg(F.sum(_mark(F.col("colour"))).alias(name))  # noqa: E731, B023
        met = now.df.join(side("src", "dst", "outs"), "dense", "left").join(side("dst", "src", "ins"), "dense", "left")
        text = F.concat_ws("|", "colour", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("outs", "ins")])
        new = Table(met.select("dense", F.md5(text).alias("colour")))
        now.drop()
        now = new
    return now.df


def histogram(graph: Graph, rounds: int = ROUNDS) -> DataFrame:
    """(colour, n)."""
    return refined(graph, rounds).groupBy("colour").agg(F.count(F.lit(1)).alias("n"))


def induced(a: Decomposition, b: Decomposition, mapping: DataFrame) -> DataFrame:
    """(component, renamed, n): how many vertices are in both; ``mapping`` is (stable, name) from the keys of a's graph to those of b's.

    Where b's graph is a's renamed, this is a bijection: one row a component, with all of its members.
    """
    names = a.graph.vertices.join(mapping.select("stable", "name"), "stable").select("dense", "name")
    here = a.membership.join(names, "dense").select("component", "name")
    there = b.membership.join(b.graph.vertices.select("dense", F.col("stable").alias("name")), "dense").select(F.col("component").alias("renamed"), "name")
    return here.join(there, "name").groupBy("component", "renamed").agg(F.count(F.lit(1)).alias("n"))
