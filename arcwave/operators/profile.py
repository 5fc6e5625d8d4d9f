"""Exact work counts as closed forms of a decomposition's dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from arcwave.control import RADIX_BUCKETS, decomposition_charges


@dataclass(frozen=True)
class WorkProfile:
    """Peaks are known only where each part ran in one task."""

    vertex_count: int
    edge_count: int
    component_count: int
    quotient_candidate_count: int
    quotient_edge_count: int
    peak_active_slots: int | None = None
    peak_frame_slots: int | None = None

    @property
    def counts(self) -> tuple[int, int, int, int, int]:
        return self.vertex_count, self.edge_count, self.component_count, self.quotient_candidate_count, self.quotient_edge_count

    @property
    def tarjan_work(self) -> int:
        return 5 * self.vertex_count + self.edge_count

    @property
    def partition_work(self) -> int:
        return 10 * self.vertex_count + self.edge_count + 3 * self.component_count + 1

    @property
    def radix_work(self) -> int:
        r = self.quotient_candidate_count
        return 0 if r < 2 else 14 * r + 13 * RADIX_BUCKETS

    @property
    def condensation_work(self) -> int:
        return 5 * self.component_count + 3 * self.quotient_edge_count + 2

    @property
    def decomposition_work(self) -> int:
        return sum(n for n, _ in decomposition_charges(*self.counts))

    def pipeline_work(self, schedule_work: int) -> int:
        return self.decomposition_work + schedule_work

    @property
    def tarjan_slots_bound(self) -> int:
        return 5 * self.vertex_count + self.component_count

    @property
    def decomposition_slots_bound(self) -> int:
        return 5 * self.vertex_count + 2 * self.component_count + 2 * self.quotient_candidate_count + RADIX_BUCKETS

    @property
    def pipeline_slots_bound(self) -> int:
        return self.decomposition_slots_bound + 2 * self.component_count

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row: dimensions, events, work by phase, and bounds."""
        v, e = self.vertex_count, self.edge_count
        row = {
            "vertex_count": v, "edge_count": e, "component_count": self.component_count, "quotient_candidate_count": self.quotient_candidate_count, "quotient_edge_count": self.quotient_edge_count,
            "root_checks": v, "discoveries": v, "edge_inspections": e, "frame_finishes": v, "active_pops": v, "canonical_assignments": v,
            "tarjan_work": self.tarjan_work, "partition_work": self.partition_work, "radix_work": self.radix_work, "condensation_work": self.condensation_work, "decomposition_work": self.decomposition_work,
            "tarjan_slots_bound": self.tarjan_slots_bound, "decomposition_slots_bound": self.decomposition_slots_bound, "pipeline_slots_bound": self.pipeline_slots_bound,
        }
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))
