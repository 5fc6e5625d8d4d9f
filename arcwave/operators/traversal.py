"""Deterministic traversals with ascending neighbours.

Breadth-first order goes level by level; inside a level, vertices sort by (least position of a parent, id). By joins, ``HOPS`` levels
are found in one plan (``levels.walked``), and what earlier plans reached is a bitmap for each range of 32,768 ids, made and tested by Spark's own
functions: an eighth of a byte a vertex in place of anti-joins with all earlier levels. Depth-first orders mark a vertex when it is pushed and take the last pushed one next. This
is breadth-depth search, which is P-complete: no parallel way is known, so each weakly connected part is walked by one task. Parts of over ``PART_EDGES``
edges reach it as a stream of sorted rows; it keeps their targets in a mapped file of its own, and 14 bytes a vertex in memory at most. A forest's trees
stay inside their parts, so parts run in parallel and only the final numbering is global.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwave.control import ExecutionControl, traversal_charges
from arcwave.functions import kernels
from arcwave.graph import Graph
from arcwave.operators.levels import HOPS, walked
from arcwave.operators.parts import PART_EDGES, each_part, part_of, parted
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import Scope, Table, cut

#: Bitmaps of up to so many bytes together are broadcast.
BITMAP_BYTES = 8 << 20
_BUCKET, _BIT = "bitmap_bucket_number(dense + 1)", "bitmap_bit_position(dense + 1)"  # Spark's ranges of ids start at 1


def _metered(graph: Graph, order: DataFrame, control: ExecutionControl) -> DataFrame:
    out = graph.edges.join(order.select(F.col("dense").alias("src")), "src", "left_semi").count()
    control.admit(traversal_charges(order.count(), out))
    return order


def breadth_first(graph: Graph, start: int, control: ExecutionControl | None = None, strategy: str = "auto") -> DataFrame:
    """(pos, dense) of what ``start`` reaches. ``auto`` keeps a part that fits one task there: a long chain has as many levels as vertices."""
    control = control or ExecutionControl()
    graph.require(start)
    control.check()
    if strategy != "distributed":
        part, size = _part_of(graph, start)
        if strategy == "local" or size <= PART_EDGES:
            return _metered(graph, cut(_in_part(graph, part, start, "breadth")), control)
    with Scope() as scope, control.running(graph.edges.sparkSession):
        order, _, _ = levels_from(graph, start)
        order = scope.keep(cut(order.select("pos", "dense")))
    return _metered(graph, order, control)


def levels_from(graph: Graph, start: int, hops: int = HOPS) -> tuple[DataFrame, int, int]:
    """((pos, dense, level) of what ``start`` reaches, the number of levels, and how many plans it took), by joins."""
    graph.require(start)
    seen = Bitmaps(graph.vertex_count)
    first = graph.edges.sparkSession.createDataFrame([(0, start)], "pos bigint, dense bigint")
    return walked(graph.edges, first, F.min, seen.marked, seen.add, hops)


class Bitmaps:
    """A set of dense ids as one bitmap of 4 KB for each range of 32,768 ids that has some."""

    def __init__(self, vertex_count: int) -> None:
        self.small = vertex_count <= BITMAP_BYTES * 8
        self.table: Table | None = None

    def add(self, rows: DataFrame) -> None:
        """Adds the ids ``dense`` of ``rows``."""
        bits = rows.groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.expr(_BIT)).alias("bits"))
        if self.table is None:
            self.table = Table(bits)
            return
        old, self.table = self.table, Table(self.table.df.unionByName(bits).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        old.drop()

    def marked(self, rows: DataFrame, column: str = "dst") -> DataFrame:
        """``rows`` with ``__seen``: whether ``column`` is in the set; a null is not."""
        bucket, bit = f"bitmap_bucket_number({column} + 1)", f"bitmap_bit_position({column} + 1)"
        bits = self.table.df.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
        byte = F.conv(F.hex(F.substring("__bits", F.expr(f"cast({bit} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
        met = rows.join(F.broadcast(bits) if self.small else bits, F.expr(bucket) == F.col("__bucket"), "left").withColumn("__byte", byte)
        held = F.expr(f"shiftright(__byte, cast({bit} % 8 as int))").bitwiseAND(1) == 1
        return met.withColumn("__seen", F.coalesce(held, F.lit(False))).drop("__bucket", "__bits", "__byte")


def _part_of(graph: Graph, start: int) -> tuple[DataFrame, int]:
    return part_of(graph.edges, graph.edge_count, start)


def _in_part(graph: Graph, part: DataFrame, start: int, kind: str) -> DataFrame:
    if part.filter((F.col("src") == start) | (F.col("dst") == start)).isEmpty():
        return graph.edges.sparkSession.createDataFrame([(0, start)], "pos bigint, dense bigint")

    def run(t: pa.Table) -> pa.Table:
        g = kernels.Local(t.column("src").to_numpy(), t.column("dst").to_numpy())
        at = int(g.ids.searchsorted(start))
        order = kernels.breadth_first(g, at) if kind == "breadth" else kernels.depth_first(g, at, set())
        return pa.table({"pos": list(range(len(order))), "dense": g.ids[order]})

    return each_part(part, run, "pos bigint, dense bigint")


#: Rows of a batch that a walk of a large part gives.
OUT_ROWS = 50_000


def _walk(vertex_count: int, start: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Depth-first orders (root, seq, dense) of one task's edges, which come sorted by (src, dst): from ``start``, or from each unvisited vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = np.zeros(vertex_count + 1, np.int64), np.zeros(vertex_count, bool)
        with tempfile.TemporaryFile() as file:
            total = 0
            for batch in batches:
                src, dst = batch.column("src").to_numpy(), batch.column("dst").to_numpy()
                own, n = np.unique(src, return_counts=True)
                row[own + 1] += n
                held[src] = held[dst] = True
                file.write(dst.astype(np.uint32).tobytes())
                total += len(dst)
            if not total:
                return
            file.flush()
            np.cumsum(row, out=row)
            to = np.asarray(np.memmap(file, np.uint32, "r", shape=(total,)))
            roots = iter([start]) if start is not None else (v for k in range(0, vertex_count, OUT_ROWS) for v in (np.flatnonzero(held[k : k + OUT_ROWS]) + k).tolist())
            out: list[tuple[int, int]] = []
            done = 0
            for turn in kernels.depth_first_rows(row, to, bytearray(vertex_count), roots):
                out.append(turn)
                if len(out) == OUT_ROWS:
                    yield _turns(out, done)
                    done, out = done + len(out), []
            yield _turns(out, done)

    return run


def _turns(out: list[tuple[int, int]], done: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"root": pa.array([r for r, _ in out], pa.int64()), "seq": pa.array(range(done, done + len(out)), pa.int64()), "dense": pa.array([v for _, v in out], pa.int64())})


def _walked(graph: Graph, edges: DataFrame, start: int | None, tasks: int = 1) -> DataFrame:
    """(root, seq, dense) of the large parts (part, src, dst), each in one task."""
    dealt = edges.repartition(tasks, "part").sortWithinPartitions("src", "dst").select("src", "dst")
    return dealt.mapInArrow(_walk(graph.vertex_count, start), "root bigint, seq bigint, dense bigint")


def depth_first(graph: Graph, start: int, control: ExecutionControl | None = None) -> DataFrame:
    """(pos, dense) of what ``start`` reaches, in the order of turns of a stack that marks on push."""
    control = control or ExecutionControl()
    graph.require(start)
    control.check()
    part, size = _part_of(graph, start)
    if size > PART_EDGES:
        order = _walked(graph, part, start).select(F.col("seq").alias("pos"), "dense")
    else:
        order = _in_part(graph, part, start, "depth")
    return _metered(graph, cut(order), control)


def depth_first_forest(graph: Graph, control: ExecutionControl | None = None) -> DataFrame:
    """(pos, root, dense): depth-first orders from each unvisited root, ascending."""
    control = control or ExecutionControl()
    if graph.vertex_count:
        control.check()
    found = parted(graph.edges, graph.edge_count)
    large, parts = found.named, found.batches

    def run(t: pa.Table) -> pa.Table:
        g = kernels.Local(t.column("src").to_numpy(), t.column("dst").to_numpy())
        seen: set[int] = set()
        roots, order = [], []
        for v in range(g.n):
            if v not in seen:
                tree = kernels.depth_first(g, v, seen)
                order += tree
                roots += [v] * len(tree)
        return pa.table({"root": g.ids[roots], "seq": list(range(len(order))), "dense": g.ids[order]})

    trees = each_part(parts, run, "root bigint, seq bigint, dense bigint")
    if large is not None:
        trees = trees.unionByName(_walked(graph, large, None, large.select("part").distinct().count()))
    found = cut(trees)
    lone = graph.vertices.select("dense").join(found.select("dense"), "dense", "left_anti").select(F.col("dense").alias("root"), F.lit(0).cast("bigint").alias("seq"), "dense")
    order = global_rank(found.unionByName(lone), [F.col("root"), F.col("seq")], "pos").select("pos", "root", "dense")
    control.admit(traversal_charges(graph.vertex_count, graph.edge_count))
    return order
