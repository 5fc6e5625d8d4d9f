"""Weakly connected parts, and grouped-map jobs over the parts that are small enough for one task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwave.operators.components import connected_components
from arcwave.plans.lineage import Table, cut

#: Most edges of a part that one task may take, and of a batch of small parts on average: some tens of MB of Python lists.
PART_EDGES = 200_000


@dataclass(frozen=True)
class Parts:
    """(part, src, dst) in batches of whole weakly connected parts, and the edges (src, dst) of parts that are too large for a task.

    ``named`` has the latter with their parts, (part, src, dst).
    """

    batches: DataFrame
    large: DataFrame | None
    single: bool
    named: DataFrame | None = None


def parted(edges: DataFrame, edge_count: int, part_edges: int = PART_EDGES, whole: bool = False, part: DataFrame | None = None) -> Parts:
    """The edges by weakly connected parts.

    A graph within one task's bound is one batch, so its parts need no names. Else parts of at most ``part_edges`` edges are dealt by hash over
    batches of that many edges on average, so that 10**8 small parts are not 10**8 calls; larger ones are left to joins. Parts are
    measured by their vertices' degrees, and edges are written with their parts only where some go to batches. ``edges`` is a written table of distinct rows.
    ``part`` has the names (node, component) of all vertices but those that name a part, where they are known.
    """
    if edge_count <= part_edges:
        return Parts(edges.select(F.lit(0).cast("bigint").alias("part"), "src", "dst"), None, True)
    part = connected_components(edges, "src", "dst", ready=True) if part is None else part
    outs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    sources = outs.join(part.select(F.col("node").alias("src"), F.col("component").alias("part")), "src", "left")
    sources = Table(sources.select("src", F.coalesce("part", "src").alias("part"), "n"), {"edges": F.sum("n")})  # a lone vertex with a self-loop is its own part
    sizes = sources.df.groupBy("part").agg(F.sum("n").alias("n"))
    over = Table(sizes.filter(F.col("n") > part_edges), {"parts": F.count(F.lit(1)), "edges": F.sum("n")})  # at most edge_count / part_edges rows
    names = F.broadcast(over.df.select("part"))
    named = edges.join(sources.df.select("src", "part"), "src").select("part", "src", "dst")
    batches = max(1, edge_count // max(part_edges, 1))
    big = large = None
    if whole or not over.seen["parts"]:
        rest = cut(named)
    elif over.seen["edges"] == sources.seen["edges"]:
        rest, big, large = named.limit(0), named, edges.select("src", "dst")
    else:
        named = cut(named)
        rest = named.join(names, "part", "left_anti")
        big = cut(named.join(names, "part", "left_semi").select("part", "src", "dst"))
        large = big.select("src", "dst")
    return Parts(rest.select(F.pmod(F.xxhash64("part"), F.lit(batches)).alias("part"), "src", "dst"), large, False, big)


def part_of(edges: DataFrame, edge_count: int, vertex: int, part_edges: int = PART_EDGES) -> tuple[DataFrame, int]:
    """(part, src, dst) of the weakly connected part of ``vertex``, or of a graph within one task's bound; and how many edges it has."""
    if edge_count <= part_edges:
        return parted(edges, edge_count, part_edges).batches, edge_count
    part = connected_components(edges, "src", "dst")
    home = part.filter(F.col("node") == vertex).select("component").limit(1)
    held = cut(part.join(F.broadcast(home), "component", "left_semi").select(F.col("node").alias("src")))
    own = cut(edges.filter(F.col("src") == vertex).unionByName(edges.filter(F.col("src") != vertex).join(held, "src", "left_semi")))  # a vertex without links has no part
    return own.select(F.lit(0).cast("bigint").alias("part"), "src", "dst"), own.count()


def each_part(parts: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel`` over the edges of each batch of parts. Batches are independent, so they spread over the cluster."""
    return parts.groupBy("part").applyInArrow(kernel, schema)
