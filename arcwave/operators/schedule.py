"""Topological order, longest-path ranks and execution waves of a condensation.

The canonical order is that of a first-in-first-out queue of released components. Its positions never fall with the
rank, and inside a rank they sort by (position of the releasing predecessor, id). So the order is lexicographic in the
chain of releasing predecessors. ``local`` takes one batch of parts at its queue's word, and finds the order across batches by
doubling. ``distributed`` finds ranks and order by joins (``levels.py``) in far fewer jobs than there are ranks. ``auto`` takes the first for parts
that fit a task and joins for the others; of a forest that the search for components followed, ranks and releasing predecessors are known.
Where each rank has one component, ranks are the order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwave.control import ExecutionControl, schedule_charges
from arcwave.errors import CondensationCycle, RankOverflow
from arcwave.functions import kernels
from arcwave.graph import U32_MAX
from arcwave.operators.condensation import Condensation
from arcwave.operators.joins import Rounds
from arcwave.operators.levels import longest_ranks, named, queue_order
from arcwave.operators.parts import PART_EDGES, Parts, each_part, parted
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import Layers, Scope, cut


@dataclass(frozen=True)
class Schedule:
    """table(component, rank, topo_pos, wave_pos)."""

    table: DataFrame
    component_count: int
    edge_count: int
    wave_count: int
    rounds: Rounds | None = None

    @property
    def logical_work(self) -> int:
        return 6 * self.component_count + self.edge_count + 3 * self.wave_count + 1

    def topological_order(self) -> DataFrame:
        return self.table.select("topo_pos", "component").orderBy("topo_pos")

    def ranks(self) -> DataFrame:
        return self.table.select("component", "rank").orderBy("component")

    def rank(self, component: int) -> int | None:
        row = self.table.filter(F.col("component") == component).first()
        return row["rank"] if row else None

    def wave(self, index: int) -> DataFrame | None:
        if not 0 <= index < self.wave_count:
            return None
        return self.table.filter(F.col("rank") == index).select("component").orderBy("component")

    def waves(self) -> DataFrame:
        """(wave, wave_start, wave_end, size)."""
        sizes = self.table.groupBy(F.col("rank").alias("wave")).agg(F.count(F.lit(1)).alias("size"), F.min("wave_pos").alias("wave_start"))
        return sizes.select("wave", "wave_start", (F.col("wave_start") + F.col("size")).alias("wave_end"), "size")

    def wave_offsets(self) -> DataFrame:
        """(pos 0..waves, offset)."""
        first = self.table.sparkSession.createDataFrame([(0, 0)], "pos bigint, offset bigint")
        return first.unionByName(self.waves().select((F.col("wave") + 1).alias("pos"), F.col("wave_end").alias("offset")))

    def wave_members(self) -> DataFrame:
        return self.table.select("wave_pos", "component").orderBy("wave_pos")

    def iterate(self, reverse: bool = False) -> Iterator[DataFrame]:
        order = range(self.wave_count - 1, -1, -1) if reverse else range(self.wave_count)
        return (self.wave(k) for k in order)


def _local(parts: DataFrame) -> DataFrame:
    """(component, rank, by, turn) of batches of whole parts."""

    def run(t: pa.Table) -> pa.Table:
        g = kernels.Local(t.column("src").to_numpy(), t.column("dst").to_numpy())
        rank, by, turns = kernels.ranks(g)
        turn = [0] * g.n
        for k, v in enumerate(turns):
            turn[v] = k
        return pa.table({"component": g.ids, "rank": rank, "by": pa.array([None if b < 0 else int(g.ids[b]) for b in by], pa.int64()), "turn": turn, "cycle": [len(turns) < g.n] * g.n})

    found = cut(each_part(parts, run, "component bigint, rank bigint, by bigint, turn bigint, cycle boolean"))
    if not found.filter("cycle").isEmpty():
        raise CondensationCycle()
    return found.drop("cycle")


def _placed(c: Condensation, parts: Parts | None, rounds: Rounds, forest: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(component, rank, topo_pos) and the number of waves; without ``parts`` and ``forest`` by joins alone."""
    every = c.edges.sparkSession.range(c.component_count).select(F.col("id").alias("v"))
    small = _local(parts.batches) if parts else None
    if forest is not None:
        ranked, by = forest.select("v", F.col("d").alias("rank")), c.edges.select(F.col("dst").alias("v"), F.col("src").alias("by"))
    elif parts and parts.large is None:
        ranked, by, turn = small.select(F.col("component").alias("v"), "rank"), small.select(F.col("component").alias("v"), "by"), small.select(F.col("component").alias("v"), "turn")
    else:
        ranked = longest_ranks(parts.large if parts else c.edges, c.component_count, rounds)
        ranked = ranked.unionByName(small.select(F.col("component").alias("v"), "rank")) if parts else ranked
    waves = (ranked.agg(F.max("rank")).first()[0] or 0) + 1 if c.component_count else 0
    ranks = cut(every.join(ranked, "v", "left").select("v", F.coalesce("rank", F.lit(0)).alias("rank")))
    if waves == c.component_count:
        order = ranks.select("v", "rank", F.col("rank").alias("pos"))
    elif forest is None and (parts is None or parts.large is not None):
        order = queue_order(c.edges, ranks, waves, rounds)
    elif parts and parts.single:  # components without edges have rank 0, where the queue goes by id
        key = F.when(F.col("rank") == 0, F.col("v")).otherwise(F.col("turn"))
        order = global_rank(ranks.join(turn, "v", "left"), [F.col("rank"), key, F.col("v")], "pos")
    else:
        order = named(ranks.join(by, "v", "left").select("v", "rank", F.col("by").alias("up")), waves, rounds)
    return order.select(F.col("v").alias("component"), "rank", F.col("pos").alias("topo_pos")), waves


def schedule(c: Condensation, strategy: str = "auto", control: ExecutionControl | None = None, part_edges: int = PART_EDGES) -> Schedule:
    """The schedule of ``c``, or an error of ``control`` and nothing."""
    control = control or ExecutionControl()
    control.check()
    rounds = Rounds()
    with Scope() as scope, control.running(c.edges.sparkSession):
        forest = c.rooted() if strategy == "auto" else None
        parts = parted(c.edges, c.edge_count, part_edges, strategy == "local") if strategy != "distributed" and forest is None else None
        table, waves = _placed(c, parts, rounds, forest)
        if waves > U32_MAX:
            raise RankOverflow()
        control.admit(schedule_charges(c.component_count, c.edge_count, waves))
        placed = table.withColumn("wave_pos", F.col("rank")) if waves == c.component_count else global_rank(table, [F.col("rank"), F.col("component")], "wave_pos")
        placed = scope.keep(cut(placed.select("component", "rank", "topo_pos", "wave_pos")))
    return Schedule(placed, c.component_count, c.edge_count, waves, rounds)


def evaluate_waves(s: Schedule, values: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Folds over the waves in order: ``step(members of a wave, values so far)`` gives rows that join the values.

    Each wave is written before the next one starts, so a wave sees all earlier ones and none of its own. A wave writes its own
    rows only; older ones are merged in layers.
    """
    done = Layers()
    done.add(values)
    for k in range(s.wave_count):
        done.add(step(s.wave(k), done.df))
    return done.df


def longest_paths(c: Condensation, s: Schedule, weights: DataFrame) -> DataFrame:
    """(component, value): weight plus the largest value of a predecessor, by waves; ``weights`` has (component, weight)."""

    def step(members: DataFrame, values: DataFrame) -> DataFrame:
        into = c.edges.join(members.select(F.col("component").alias("dst")), "dst", "left_semi").join(values.select(F.col("component").alias("src"), "value"), "src")
        best = into.groupBy(F.col("dst").alias("component")).agg(F.max("value").alias("best"))
        return members.join(weights, "component").join(best, "component", "left").select("component", (F.col("weight") + F.coalesce("best", F.lit(0))).alias("value"))

    return evaluate_waves(s, c.edges.sparkSession.createDataFrame([], "component bigint, value bigint"), step)
