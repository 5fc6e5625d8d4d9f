"""Graphs from compressed rows that were made elsewhere: checked in a fixed order, never repaired."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.errors import AdjacencyOrder, GraphError, OffsetLength, OffsetOrder, OffsetOrigin, OffsetTerminal, ReverseEdgeCount, ReverseEdgeMissing, StableNodeOrder, TargetOutOfRange, VertexDomainOverflow
from arcwave.graph import FORWARD, REVERSE, U32_MAX, Graph
from arcwave.plans.lineage import cut


@dataclass(frozen=True)
class Rows:
    """offsets(pos, offset) and targets(pos, target) of one direction."""

    offsets: DataFrame
    targets: DataFrame

    @staticmethod
    def of(spark: SparkSession, offsets: Sequence[int], targets: Sequence[int]) -> Rows:
        frame = lambda x, c: spark.createDataFrame(list(enumerate(x)), f"pos bigint, {c} bigint")
        return Rows(frame(offsets, "offset"), frame(targets, "target"))

    def edges(self) -> DataFrame:
        """(src, pos, dst)."""
        end = self.offsets.select((F.col("pos") - 1).alias("pos"), F.col("offset").alias("end"))
        held = self.offsets.join(end, "pos").filter("end > offset")
        places = held.select(F.col("pos").alias("src"), F.explode(F.sequence("offset", F.col("end") - 1)).alias("pos"))
        return places.join(self.targets, "pos").select("src", "pos", F.col("target").alias("dst"))


def _first(df: DataFrame, *columns: str) -> tuple | None:
    """The least row by these columns."""
    row = df.agg(F.min(F.struct(*columns)).alias("x")).first()["x"]
    return tuple(row) if row is not None else None


def _row_violation(rows: Rows, vertex_count: int, direction: str) -> GraphError | None:
    offsets, targets = rows.offsets, rows.targets
    size, edges = offsets.count(), targets.count()
    if size != vertex_count + 1:
        return OffsetLength(direction, vertex_count + 1, size)
    ends = {r["pos"]: r["offset"] for r in offsets.filter(F.col("pos").isin(0, vertex_count)).collect()}
    if ends[0] != 0:
        return OffsetOrigin(direction, ends[0])
    after = lambda df, c: df.select((F.col("pos") + 1).alias("pos"), F.col(c).alias("previous"))
    bad = _first(offsets.join(after(offsets, "offset"), "pos").filter("previous > offset"), "pos", "previous", "offset")
    if bad:
        return OffsetOrder(direction, *bad)
    if ends[vertex_count] != edges:
        return OffsetTerminal(direction, edges, ends[vertex_count])
    bad = _first(targets.filter((F.col("target") < 0) | (F.col("target") >= vertex_count)), "pos", "target")
    if bad:
        return TargetOutOfRange(direction, *bad, vertex_count)
    heads = offsets.select(F.col("offset").alias("pos")).distinct()
    same_row = targets.join(after(targets, "target"), "pos").join(heads, "pos", "left_anti")
    bad = _first(same_row.filter("previous >= target"), "pos", "previous", "target")
    if bad:
        source = offsets.filter(F.col("offset") <= bad[0]).agg(F.max("pos")).first()[0]
        return AdjacencyOrder(direction, source, *bad)
    return None


def first_violation(nodes: DataFrame, forward: Rows, reverse: Rows | None = None) -> GraphError | None:
    """The first broken law of explicit parts; ``nodes`` has (pos, stable)."""
    count = nodes.count()
    before = nodes.select((F.col("pos") + 1).alias("pos"), F.col("stable").alias("previous"))
    bad = _first(nodes.join(before, "pos").filter("previous >= stable"), "pos")
    if bad:
        return StableNodeOrder(bad[0])
    if count > U32_MAX:
        return VertexDomainOverflow(count)
    found = _row_violation(forward, count, FORWARD)
    if found or reverse is None:
        return found
    found = _row_violation(reverse, count, REVERSE)
    if found:
        return found
    sizes = forward.targets.count(), reverse.targets.count()
    if sizes[0] != sizes[1]:
        return ReverseEdgeCount(*sizes)
    mirror = reverse.edges().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    missing = _first(forward.edges().join(mirror, ["src", "dst"], "left_anti"), "dst", "src")
    return ReverseEdgeMissing(missing[1], missing[0]) if missing else None


def from_parts(nodes: DataFrame, forward: Rows, reverse: Rows | None = None) -> Graph:
    bad = first_violation(nodes, forward, reverse)
    if bad:
        raise bad
    edges = cut(forward.edges().select("src", "dst"))
    return Graph(cut(nodes.select(F.col("pos").alias("dense"), "stable")), edges, nodes.count(), edges.count(), reverse is not None)
