"""Table functions for ``spark.sql``: components and ranks of the graphs that a partitioning keeps apart.

    register(spark)
    spark.sql("SELECT * FROM graph_components(TABLE(pairs) PARTITION BY user_id)")

The first two columns besides the partitioning ones, in a subquery (part, src, dst), are the ends of an edge, of any orderable type; a null end makes the
other a vertex without that edge. Each partition is one graph in one task, so partition by what bounds a graph's size; a graph that is
one part belongs to ``decompose``. Rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from arcwave.functions import kernels


class _Gathered:
    def __init__(self) -> None:
        self.part: Any = None
        self.pairs: set[tuple] = set()
        self.keys: set = set()

    def eval(self, row: Row) -> None:
        self.part, src, dst = row[0], row[1], row[2]
        self.keys.update(k for k in (src, dst) if k is not None)
        if src is not None and dst is not None:
            self.pairs.add((src, dst))

    def local(self) -> tuple[list, kernels.Local | None, list[int]]:
        """Keys in ascending order, the part over their places, and the places that have edges."""
        keys = sorted(self.keys)
        at = {k: i for i, k in enumerate(keys)}
        if not self.pairs:
            return keys, None, []
        ends = np.array([(at[a], at[b]) for a, b in self.pairs], np.int64)
        g = kernels.Local(ends[:, 0], ends[:, 1])
        return keys, g, g.ids.tolist()


class GraphComponents(_Gathered):
    """(part, vertex, least, cyclic): the least vertex of each vertex's strongly connected component."""

    def terminate(self) -> Iterator[tuple]:
        keys, g, places = self.local()
        least = dict(zip(places, (places[x] for x in kernels.components(g)[0]), strict=True)) if g else {}
        size: dict[int, int] = {}
        for i in range(len(keys)):
            size[least.get(i, i)] = size.get(least.get(i, i), 0) + 1
        for i, key in enumerate(keys):
            root = least.get(i, i)
            yield str(self.part), str(key), str(keys[root]), size[root] > 1 or (keys[i], keys[i]) in self.pairs


class GraphRanks(_Gathered):
    """(part, vertex, rank): the longest path to each vertex, null for all vertices of a part with a cycle."""

    def terminate(self) -> Iterator[tuple]:
        keys, g, places = self.local()
        rank: dict[int, int] = {}
        cycle = False
        if g:
            found, _, turns = kernels.ranks(g)
            rank, cycle = dict(zip(places, found, strict=True)), len(turns) < g.n
        for i, key in enumerate(keys):
            yield str(self.part), str(key), None if cycle else rank.get(i, 0)


def register(spark: SparkSession) -> None:
    """``graph_components`` and ``graph_ranks`` for this session."""
    spark.udtf.register("graph_components", udtf(GraphComponents, returnType="part string, vertex string, least string, cyclic boolean"))
    spark.udtf.register("graph_ranks", udtf(GraphRanks, returnType="part string, vertex string, rank bigint"))
