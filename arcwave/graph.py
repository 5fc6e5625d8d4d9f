"""Canonical directed graphs over DataFrames.

``vertices(dense, stable)`` numbers the distinct keys in ascending order from 0; ``edges(src, dst)`` is the set of
distinct dense pairs, self-loops included. Both are written once, so every later plan starts from a file. Counts and
input errors are settled when a graph is built: a handle always stands for a valid graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwave.errors import DenseIdOutOfRange, EdgeDomainOverflow, EdgeInputLimitExceeded, UnknownEndpoint, VertexDomainOverflow, VertexInputLimitExceeded
from arcwave.operators.ranking import global_rank, with_position
from arcwave.plans.lineage import cut, sorted_table
from arcwave.plans.spread import spread_join

U32_MAX = 2**32 - 1
FORWARD, REVERSE = "Forward", "Reverse"


@dataclass(frozen=True)
class GraphLimits:
    """Most raw inputs, counted before duplicates go."""

    max_vertex_inputs: int = U32_MAX
    max_edge_inputs: int = U32_MAX


@dataclass(frozen=True)
class BuildOptions:
    limits: GraphLimits = field(default_factory=GraphLimits)
    build_reverse: bool = True


@dataclass(frozen=True)
class GraphIndex:
    """The graph's tables once more, each sorted by the column that its lookups ask for, so that Parquet's statistics leave one page of rows to read."""

    by_dense: DataFrame
    by_stable: DataFrame
    by_src: DataFrame
    by_dst: DataFrame | None


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    vertex_count: int
    edge_count: int
    has_reverse: bool = True
    index: GraphIndex | None = field(default=None, compare=False)

    # construction

    @staticmethod
    def from_edges(nodes: DataFrame, edges: DataFrame, options: BuildOptions | None = None) -> Graph:
        """A graph from keys (the first column of ``nodes``) and pairs (the first two columns of ``edges``).

        Input order decides which bad edge is reported: a column ``edge_index`` gives it, else the order of reading.
        Keys may have any orderable type but floating point; null keys are refused.
        """
        options = options or BuildOptions()
        keys = nodes.select(F.col(nodes.columns[0]).alias("stable"))
        if isinstance(keys.schema["stable"].dataType, (T.FloatType, T.DoubleType, T.MapType, T.VariantType)):
            raise TypeError("graph keys must have a total order")
        seen = keys.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stable").isNull()).alias("nulls")).first()
        if seen["n"] > options.limits.max_vertex_inputs:
            raise VertexInputLimitExceeded(options.limits.max_vertex_inputs)
        if seen["nulls"]:
            raise ValueError("graph keys must not be null")
        vertices = cut(global_rank(keys.distinct(), [F.col("stable")], "dense").select("dense", "stable"))
        count = vertices.count()
        if count > U32_MAX:
            raise VertexDomainOverflow(count)
        src, dst = [c for c in edges.columns if c != "edge_index"][:2]
        raw = edges if "edge_index" in edges.columns else with_position(edges, "edge_index")
        raw = raw.select("edge_index", F.col(src).alias("s"), F.col(dst).alias("t"))
        from_, to = (vertices.select(F.col("stable").alias(a), F.col("dense").alias(b)) for a, b in (("s", "src"), ("t", "dst")))
        return _settled(vertices, count, raw.join(from_, "s", "left").join(to, "t", "left").select("edge_index", "src", "dst"), options)

    @staticmethod
    def from_dense_edges(spark: SparkSession, vertex_count: int, edges: DataFrame, options: BuildOptions | None = None) -> Graph:
        """A graph over the keys 0..vertex_count; endpoints are checked by range instead of by joins."""
        options = options or BuildOptions()
        if vertex_count > options.limits.max_vertex_inputs:
            raise VertexInputLimitExceeded(options.limits.max_vertex_inputs)
        vertices = spark.range(vertex_count).select(F.col("id").alias("dense"), F.col("id").alias("stable"))
        src, dst = [c for c in edges.columns if c != "edge_index"][:2]
        raw = edges if "edge_index" in edges.columns else with_position(edges, "edge_index")
        inside = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < vertex_count), F.col(c).cast("bigint"))
        return _settled(vertices, vertex_count, raw.select("edge_index", inside(src).alias("src"), inside(dst).alias("dst")), options)

    def with_reverse(self) -> Graph:
        return replace(self, has_reverse=True)

    def indexed(self) -> Graph:
        """The same graph with tables for lookups: one range sort for each, worth it from a few lookups on."""
        by = lambda df, *keys: sorted_table(df, keys)
        return replace(self, index=GraphIndex(by(self.vertices, "dense"), by(self.vertices, "stable"), by(self.edges, "src", "dst"), by(self.edges, "dst", "src") if self.has_reverse else None))

    # projections and lookups

    def nodes(self) -> DataFrame:
        return self.vertices.orderBy("dense")

    def ordered_edges(self) -> DataFrame:
        return self.edges.orderBy("src", "dst")

    def dense_id(self, key: Any) -> int | None:
        held = self.index.by_stable if self.index else self.vertices
        row = held.filter(F.col("stable") == F.lit(key)).select("dense").first()
        return row["dense"] if row else None

    def stable_id(self, dense: int) -> Any:
        self.require(dense)
        held = self.index.by_dense if self.index else self.vertices
        return held.filter(F.col("dense") == dense).first()["stable"]

    def require(self, dense: int) -> None:
        if not 0 <= dense < self.vertex_count:
            raise DenseIdOutOfRange(dense, self.vertex_count)

    def successors(self, dense: int) -> DataFrame:
        self.require(dense)
        held = self.index.by_src if self.index else self.edges
        return held.filter(F.col("src") == dense).select("dst").orderBy("dst")

    def predecessors(self, dense: int) -> DataFrame | None:
        self.require(dense)
        held = (self.index and self.index.by_dst) or self.edges
        return held.filter(F.col("dst") == dense).select("src").orderBy("src") if self.has_reverse else None

    def contains_edge(self, src: int, dst: int) -> bool:
        held = self.index.by_src if self.index else self.edges
        return not held.filter((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def directed(self, direction: str = FORWARD) -> DataFrame:
        """The edges, or their transpose."""
        return self.edges if direction == FORWARD else self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    def adjacency(self, direction: str = FORWARD) -> DataFrame:
        """(src, dst, pos): each neighbour with its place in the ascending row of its vertex."""
        placed = global_rank(self.directed(direction), [F.col("src"), F.col("dst")], "at")
        rows = cut(placed.groupBy("src").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")))
        met = spread_join(placed, rows.select("src", "start"), ["src"], "dst", counts=rows.select("src", "n"))
        return met.select("src", "dst", (F.col("at") - F.col("start")).alias("pos"))

    def offsets(self, direction: str = FORWARD) -> DataFrame:
        """(pos 0..V, offset) of the compressed rows."""
        degrees = self.vertices.select("dense").join(self.directed(direction).groupBy(F.col("src").alias("dense")).agg(F.count(F.lit(1)).alias("n")), "dense", "left")
        sums = running_sum(degrees.select("dense", F.coalesce("n", F.lit(0)).alias("n")), "dense", "n", "offset")
        first = self.vertices.sparkSession.createDataFrame([(0, 0)], "pos bigint, offset bigint")
        return first.unionByName(sums.select((F.col("dense") + 1).alias("pos"), "offset"))

    def targets(self, direction: str = FORWARD) -> DataFrame:
        """(pos 0..E-1, target) of the compressed rows."""
        return global_rank(self.directed(direction), [F.col("src"), F.col("dst")], "pos").select("pos", F.col("dst").alias("target"))

    def same_as(self, other: Graph) -> bool:
        """Equality of keys, edges and the reverse flag: counts, then fingerprints, and a join of all rows only where these agree."""
        differ = lambda a, b: not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()
        if self.has_reverse != other.has_reverse or (self.vertex_count, self.edge_count) != (other.vertex_count, other.edge_count):
            return False
        if sorted(map(tuple, self.fingerprints().collect())) != sorted(map(tuple, other.fingerprints().collect())):
            return False
        return not differ(self.vertices, other.vertices) and not differ(self.edges, other.edges)

    def fingerprints(self) -> DataFrame:
        """(part, n, low, high) of vertices and edges: equal for equal sets whatever the order, found in one pass without a shuffle of rows."""
        return fingerprint(self.vertices.select("dense", "stable"), "vertices").unionByName(fingerprint(self.edges.select("src", "dst"), "edges"))

    def renamed(self, mapping: DataFrame) -> Graph:
        """The graph with each key replaced by ``mapping(stable, name)``, canonical again; the mapping must be a bijection on the keys."""
        named = self.vertices.join(mapping.select("stable", "name"), "stable")
        ends = lambda c: named.select(F.col("dense").alias(c), F.col("name").alias(f"n_{c}"))
        return Graph.from_edges(named.select("name"), self.edges.join(ends("src"), "src").join(ends("dst"), "dst").select("n_src", "n_dst"))


def fingerprint(rows: DataFrame, part: str) -> DataFrame:
    """(part, n, low, high): the number of rows and the sums of both halves (15 hex digits each) of their MD5, an order-free mark of a multiset."""
    digest = F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns]))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring("m", at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return rows.select(digest.alias("m")).agg(F.count(F.lit(1)).alias("n"), half(1).alias("low"), half(16).alias("high")).select(F.lit(part).alias("part"), "n", "low", "high")


def running_sum(df: DataFrame, key: str, value: str, name: str, chunk: int = 65_536) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of the dense 0-based ``key``: windows inside chunks of keys, and one over the chunks' sums."""
    part = df.withColumn("__c", F.expr(f"{key} div {chunk}"))
    inside = part.withColumn("__s", F.sum(value).over(Window.partitionBy("__c").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    sums = part.groupBy("__c").agg(F.sum(value).alias("__t"))
    before = sums.withColumn("__b", F.coalesce(F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__c", "__b")
    return inside.join(before, "__c").withColumn(name, (F.col("__s") + F.col("__b")).cast("bigint")).drop("__c", "__s", "__b")


def _settled(vertices: DataFrame, count: int, resolved: DataFrame, options: BuildOptions) -> Graph:
    resolved = cut(resolved)
    bad = F.when(F.col("src").isNull(), F.struct("edge_index", F.lit(0).alias("end"))).when(F.col("dst").isNull(), F.struct("edge_index", F.lit(1).alias("end")))
    seen = resolved.agg(F.count(F.lit(1)).alias("n"), F.min(bad).alias("bad")).first()
    limit = options.limits.max_edge_inputs
    if seen["bad"] is not None and seen["bad"]["edge_index"] < limit:
        raise UnknownEndpoint(seen["bad"]["edge_index"], ("Source", "Target")[seen["bad"]["end"]])
    if seen["n"] > limit:
        raise EdgeInputLimitExceeded(limit)
    edges = cut(resolved.select("src", "dst").distinct())
    total = edges.count()
    if total > U32_MAX:
        raise EdgeDomainOverflow(total)
    return Graph(vertices, edges, count, total, options.build_reverse)
