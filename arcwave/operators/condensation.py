"""The quotient of a graph by its components: an acyclic graph over component ids, without self-loops."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwave.errors import ComponentIdOutOfRange, InvalidPartition
from arcwave.plans.lineage import cut, sorted_table

if TYPE_CHECKING:
    from arcwave.control import ExecutionControl
    from arcwave.graph import Graph
    from arcwave.operators.schedule import Schedule


@dataclass(frozen=True)
class Condensation:
    """edges(src, dst) over components 0..component_count.

    ``forest`` is what ``levels.rooted`` found, behind the edges that it is of, where the search for components needed it.
    """

    edges: DataFrame
    component_count: int
    edge_count: int
    by_src: DataFrame | None = field(default=None, compare=False)
    by_dst: DataFrame | None = field(default=None, compare=False)
    forest: tuple[DataFrame, DataFrame] | None = field(default=None, compare=False)

    def indexed(self) -> Condensation:
        """The same quotient with its edges sorted once for each direction of lookups."""
        return replace(self, by_src=sorted_table(self.edges, ("src", "dst")), by_dst=sorted_table(self.edges, ("dst", "src")))

    def require(self, component: int) -> None:
        if not 0 <= component < self.component_count:
            raise ComponentIdOutOfRange(component, self.component_count)

    def successors(self, component: int) -> DataFrame:
        self.require(component)
        return (self.by_src or self.edges).filter(F.col("src") == component).select("dst").orderBy("dst")

    def predecessors(self, component: int) -> DataFrame:
        self.require(component)
        return (self.by_dst or self.edges).filter(F.col("dst") == component).select("src").orderBy("src")

    def ordered_edges(self) -> DataFrame:
        return self.edges.orderBy("src", "dst")

    def transposed(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    def rooted(self) -> DataFrame | None:
        """Roots and depths, if they are known of these very edges."""
        return self.forest[1] if self.forest and self.forest[0] is self.edges else None

    def schedule(self, strategy: str = "auto", control: ExecutionControl | None = None) -> Schedule:
        from arcwave.operators.schedule import schedule

        return schedule(self, strategy, control)

    def validate(self) -> None:
        inside = lambda c: (F.col(c) >= 0) & (F.col(c) < self.component_count)
        if not self.edges.filter(~(inside("src") & inside("dst"))).isEmpty():
            raise InvalidPartition("an edge leaves the component domain")
        if not self.edges.filter("src = dst").isEmpty():
            raise InvalidPartition("the quotient has a self-loop")
        if not self.edges.groupBy("src", "dst").count().filter("count > 1").isEmpty():
            raise InvalidPartition("the quotient repeats an edge")
        self.schedule()


def quotient(graph: Graph, membership: DataFrame, component_count: int) -> tuple[Condensation, int]:
    """The condensation, and how many edges crossed components before they were made distinct."""
    ends = graph.edges.join(membership.select(F.col("dense").alias("src"), F.col("component").alias("cs")), "src").join(membership.select(F.col("dense").alias("dst"), F.col("component").alias("cd")), "dst")
    counted = cut(ends.filter("cs <> cd").groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst")).agg(F.count(F.lit(1)).alias("n")))
    seen = counted.agg(F.count(F.lit(1)).alias("q"), F.sum("n").alias("r")).first()
    return Condensation(counted.select("src", "dst"), component_count, seen["q"]), seen["r"] or 0
