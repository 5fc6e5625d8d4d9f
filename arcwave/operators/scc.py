"""Strongly connected components in canonical order, their cycle flags, and the exact quotient.

``local`` runs a linear-time helper on batches of weakly connected parts, in parallel over batches.
``distributed`` uses joins alone (``joins.py``): contraction of chains and floods with shortcuts, in rounds that grow with the logarithm of the
depth. ``auto`` takes the first for parts that fit a task and joins for the others, until what is left of them fits one;
graphs of many edges a vertex go to joins whole, and a forest with a tree over a task's bound is its own quotient. All give the same tables, as ids are
assigned afterwards: a component's id is the rank of its least member. A giant component is one key of some joins; its rows are
dealt over tasks there, as component sizes are known.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwave.control import ExecutionControl, decomposition_charges
from arcwave.errors import ComponentIdOutOfRange, InvalidPartition
from arcwave.functions import kernels
from arcwave.graph import Graph, running_sum
from arcwave.operators.condensation import Condensation, quotient
from arcwave.operators.joins import Rounds, components_by_joins, flooded
from arcwave.operators.levels import rooted
from arcwave.operators.parts import PART_EDGES, each_part, parted
from arcwave.operators.profile import WorkProfile
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import Scope, cut, sorted_table
from arcwave.plans.spread import spread_join


#: Edges a vertex from which on a graph over one task's bound goes to joins without a search for small parts, which would cost as much as the joins do.
DENSE = 8


def _local(parts: DataFrame) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        g = kernels.Local(t.column("src").to_numpy(), t.column("dst").to_numpy())
        least, most_open, most_frames = kernels.components(g)
        return pa.table({"dense": g.ids, "least": g.ids[least], "open_slots": [most_open] * g.n, "frame_slots": [most_frames] * g.n})

    return each_part(parts, run, "dense bigint, least bigint, open_slots bigint, frame_slots bigint")


def _core(edges: DataFrame) -> DataFrame:
    """(v, rep) of the (a, b) that contraction has left, few enough for one task."""
    parts = edges.select(F.lit(0).cast("bigint").alias("part"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return _local(parts).select(F.col("dense").alias("v"), F.col("least").alias("rep"))


@dataclass(frozen=True)
class Decomposition:
    """membership(dense, component); components(component, member_start, member_end, member_count, cyclic, self_cycle, multi_vertex_cycle)."""

    graph: Graph
    membership: DataFrame
    components: DataFrame
    condensation: Condensation
    profile: WorkProfile
    rounds: Rounds | None = None
    by_component: DataFrame | None = field(default=None, compare=False)

    def indexed(self) -> Decomposition:
        """The same decomposition with its tables sorted for lookups by vertex and by component."""
        return replace(self, membership=sorted_table(self.membership, ("dense",)), by_component=sorted_table(self.membership, ("component", "dense")), components=sorted_table(self.components, ("component",)), condensation=self.condensation.indexed())

    @property
    def component_count(self) -> int:
        return self.condensation.component_count

    def fibers(self) -> DataFrame:
        """(pos, component, dense): members in ascending order inside ascending components."""
        return global_rank(self.membership, [F.col("component"), F.col("dense")], "pos").select("pos", "component", "dense")

    def component_of(self, dense: int) -> int:
        self.graph.require(dense)
        return self.membership.filter(F.col("dense") == dense).first()["component"]

    def component(self, component: int) -> dict:
        self._require(component)
        return self.components.filter(F.col("component") == component).first().asDict()

    def fiber(self, component: int) -> DataFrame:
        self._require(component)
        return (self.by_component or self.membership).filter(F.col("component") == component).select("dense").orderBy("dense")

    def cyclic_components(self) -> DataFrame:
        return self.components.filter("cyclic")

    def is_acyclic(self) -> bool:
        return self.cyclic_components().isEmpty()

    def _require(self, component: int) -> None:
        if not 0 <= component < self.component_count:
            raise ComponentIdOutOfRange(component, self.component_count)

    def violations(self) -> DataFrame:
        """(law, broken bigint): how many rows break each law of a decomposition; all 0 for a valid one."""
        g, m, c = self.graph, self.membership, self.components
        ends = g.edges.join(m.select(F.col("dense").alias("src"), F.col("component").alias("cs")), "src").join(m.select(F.col("dense").alias("dst"), F.col("component").alias("cd")), "dst")
        cross = ends.filter("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()
        looped = ends.filter("src = dst").select(F.col("cs").alias("component")).distinct().withColumn("loop", F.lit(True))
        counted = m.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("dense").alias("least"))
        flags = c.join(counted, "component", "full").join(looped, "component", "left")
        q = self.condensation.edges
        laws = {
            "total": g.vertices.select("dense").exceptAll(m.select("dense")),
            "in domain": m.select("dense").exceptAll(g.vertices.select("dense")),
            "fibers contiguous": c.join(c.select((F.col("component") + 1).alias("component"), F.col("member_end").alias("before")), "component", "left").filter(F.col("member_start") != F.coalesce("before", F.lit(0))),
            "fiber sizes": flags.filter("n is null or member_count is null or n <> member_count or member_end - member_start <> n"),
            "order by least member": flags.join(flags.select((F.col("component") + 1).alias("component"), F.col("least").alias("last")), "component").filter("least <= last"),
            "cycle flags": flags.filter(F.col("cyclic") != ((F.col("n") > 1) | F.coalesce("loop", F.lit(False)))),
            "quotient complete": cross.exceptAll(q.select("src", "dst")),
            "quotient sound": q.select("src", "dst").exceptAll(cross),
            "strongly connected": self.unconnected(),
        }
        out = None
        for law, rows in laws.items():
            one = rows.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(law).alias("law"), "broken")
            out = one if out is None else out.unionByName(one)
        return out

    def unconnected(self) -> DataFrame:
        """(component, unreached, unreaching) of components that are none: how many members the largest one doesn't reach by edges inside, and how many don't reach it."""
        m = self.membership
        ends = self.graph.edges.filter("src <> dst").join(m.select(F.col("dense").alias("src"), F.col("component").alias("cs")), "src").join(m.select(F.col("dense").alias("dst"), F.col("component").alias("cd")), "dst")
        inner = cut(ends.filter("cs = cd").select(F.col("src").alias("a"), F.col("dst").alias("b")))
        members = m.select(F.col("dense").alias("v"))
        there = flooded(members, inner, Rounds()).withColumnRenamed("c", "there")
        back = flooded(members, inner.select(F.col("b").alias("a"), F.col("a").alias("b")), Rounds()).withColumnRenamed("c", "back")
        last = m.groupBy("component").agg(F.max("dense").alias("last"), F.count(F.lit(1)).alias("n"))
        last = cut(last)
        seen = m.select(F.col("dense").alias("v"), "component").join(there, "v").join(back, "v")
        seen = spread_join(cut(seen), last.select("component", "last"), ["component"], "v", counts=last.select("component", "n"))
        return seen.groupBy("component").agg(F.count_if(F.col("there") != F.col("last")).alias("unreached"), F.count_if(F.col("back") != F.col("last")).alias("unreaching")).filter("unreached + unreaching > 0")

    def validate(self) -> None:
        broken = self.violations().filter("broken > 0").orderBy("law").first()
        if broken:
            raise InvalidPartition(broken["law"])
        self.condensation.validate()


def _tables(graph: Graph, named: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame, Condensation, int]:
    """Membership, components, quotient and the number of crossing edges, from (dense, least) of every vertex."""
    sized = named.groupBy("least").agg(F.count(F.lit(1)).alias("member_count"))
    order = cut(global_rank(sized, [F.col("least")], "component"))
    membership = scope.keep(cut(spread_join(named, order.select("least", "component"), ["least"], "dense", counts=order.select("least", F.col("member_count").alias("n"))).select("dense", "component")))
    loops = graph.edges.filter("src = dst").select(F.col("src").alias("dense")).join(membership, "dense").select("component").distinct().withColumn("loop", F.lit(True))
    sums = running_sum(order.select("component", "member_count"), "component", "member_count", "member_end")
    loop = F.coalesce("loop", F.lit(False))
    many = F.col("member_count") > 1
    components = scope.keep(cut(sums.join(loops, "component", "left").select("component", (F.col("member_end") - F.col("member_count")).alias("member_start"), "member_end", "member_count", (many | loop).alias("cyclic"), (~many & loop).alias("self_cycle"), many.alias("multi_vertex_cycle"))))
    condensation, candidates = quotient(graph, membership, components.count())
    condensation = replace(condensation, edges=scope.keep(condensation.edges))
    return membership, components, condensation, candidates


def _alone(graph: Graph) -> tuple[DataFrame, DataFrame, Condensation, int]:
    """The same of a graph without cycles, where each vertex is a component: no table has to be written."""
    v, no = F.col("dense"), F.lit(False)
    membership = graph.vertices.select("dense", v.alias("component"))
    components = graph.vertices.select(v.alias("component"), v.alias("member_start"), (v + 1).alias("member_end"), F.lit(1).cast("bigint").alias("member_count"), no.alias("cyclic"), no.alias("self_cycle"), no.alias("multi_vertex_cycle"))
    return membership, components, Condensation(graph.edges.select("src", "dst"), graph.vertex_count, graph.edge_count), graph.edge_count


def regrouped(d: Decomposition, groups: DataFrame) -> Decomposition:
    """``d`` with the groups of (dense, component) in place of its components, and all tables made to fit: for checks of what ``violations`` finds."""
    with Scope() as scope:
        least = groups.groupBy("component").agg(F.min("dense").alias("least"))
        named = cut(groups.join(least, "component").select("dense", "least"))
        membership, components, condensation, _ = _tables(d.graph, named, scope)
    return replace(d, membership=membership, components=components, condensation=condensation)


def _named(graph: Graph, strategy: str, part_edges: int, dense: bool, forest: DataFrame | None) -> tuple[DataFrame, Rounds | None, tuple[int | None, int | None]]:
    """(dense, least) of every vertex, written; the rounds of joins, if any, and the peaks of stacks where each part ran in one task."""
    peaks: tuple[int | None, int | None] = (None, None)
    rounds = None
    names = forest.select(F.col("v").alias("node"), F.col("last").alias("component")) if forest is not None else None
    parts = parted(graph.edges, graph.edge_count, part_edges, strategy == "local", names) if strategy != "distributed" and not dense else None
    if parts is None:
        rounds = Rounds()
        raw = components_by_joins(graph.edges, rounds, part_edges, _core) if dense else components_by_joins(graph.edges, rounds)
    else:
        small = cut(_local(parts.batches))
        raw = small.select("dense", "least")
        if parts.large is None:
            top = small.agg(F.max("open_slots").alias("o"), F.max("frame_slots").alias("f")).first()
            alone = min(graph.vertex_count, 1)
            peaks = (max(top["o"] or 0, alone), max(top["f"] or 0, alone))
        else:
            rounds = Rounds()
            raw = raw.unionByName(components_by_joins(parts.large, rounds, part_edges, _core))
    named = graph.vertices.select("dense").join(raw.select("dense", "least"), "dense", "left").select("dense", F.coalesce("least", "dense").alias("least"))
    return cut(named), rounds, peaks


def decompose(graph: Graph, strategy: str = "auto", control: ExecutionControl | None = None, part_edges: int = PART_EDGES) -> Decomposition:
    """The strongly connected components of ``graph``, or an error of ``control`` and nothing: no table stays but those of the result."""
    control = control or ExecutionControl()
    control.check()
    control.admit(decomposition_charges(graph.vertex_count, graph.edge_count, 0, 0, 0)[:2])  # a bound known before any job
    if strategy not in ("auto", "local", "distributed"):
        raise ValueError(f"no strategy {strategy!r}")
    with Scope() as scope, control.running(graph.edges.sparkSession):
        peaks: tuple[int | None, int | None] = (None, None)
        rounds = None
        dense = strategy == "auto" and graph.edge_count > max(part_edges, DENSE * graph.vertex_count)
        forest = None
        if strategy == "auto" and part_edges < graph.edge_count < graph.vertex_count:  # a forest has fewer edges than vertices
            forest = rooted(graph.edges, graph.edge_count, Rounds())
        if forest is not None and not forest.groupBy("last").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_edges).isEmpty():
            membership, components, condensation, candidates = _alone(graph)
        else:
            named, rounds, peaks = _named(graph, strategy, part_edges, dense, forest)
            membership, components, condensation, candidates = _tables(graph, named, scope)
        if forest is not None:
            condensation = replace(condensation, forest=(condensation.edges, scope.keep(forest)))
    profile = WorkProfile(graph.vertex_count, graph.edge_count, condensation.component_count, candidates, condensation.edge_count, *peaks)
    control.admit(decomposition_charges(*profile.counts))
    return Decomposition(graph, membership, components, condensation, profile, rounds)
