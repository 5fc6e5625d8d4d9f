"""Work budgets and cancellation.

Work is a closed form of a graph's counts, so a budget is judged against a ledger of charges instead of
by metering: a batch that does not fit stops with what was consumed before it, a run of unit charges stops
exactly at the limit. Nothing is returned from a run that does not fit.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from arcwave.errors import Cancelled, WorkLimitExceeded

UNLIMITED = 2**64 - 1
POLL_SECONDS = 0.2
RADIX_BUCKETS = 2048  # of the work model's sort; a fixed value


@dataclass(frozen=True)
class ExecutionControl:
    """A limit on logical work, and an event that cancels."""

    work_limit: int = UNLIMITED
    cancellation: threading.Event | None = field(default=None, compare=False)

    @staticmethod
    def unlimited() -> ExecutionControl:
        return ExecutionControl()

    @staticmethod
    def with_work_limit(limit: int) -> ExecutionControl:
        return ExecutionControl(limit)

    def with_cancellation(self, event: threading.Event) -> ExecutionControl:
        return ExecutionControl(self.work_limit, event)

    def check(self, consumed: int = 0) -> None:
        if self.cancellation is not None and self.cancellation.is_set():
            raise Cancelled(consumed)

    @contextmanager
    def running(self, spark: SparkSession) -> Iterator[None]:
        """Jobs of the block end soon after the event is set, those that run too, and the block ends with ``Cancelled``.

        The block's jobs carry a tag, and a thread that waits for the event cancels the jobs with that tag.
        """
        if self.cancellation is None:
            yield
            return
        context = spark.sparkContext
        tag, over = f"arcwave-{uuid.uuid4().hex}", threading.Event()

        def watch() -> None:
            while not over.wait(POLL_SECONDS):
                if self.cancellation.is_set():
                    context.cancelJobsWithTag(tag)  # again each time: a job may start between two looks

        context.addJobTag(tag)
        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        except Exception as e:
            if self.cancellation.is_set() and not isinstance(e, Cancelled):
                raise Cancelled(0) from e
            raise
        finally:
            over.set()
            thread.join()
            context.removeJobTag(tag)
        self.check()

    def admit(self, charges: Iterable[tuple[int, bool]]) -> int:
        """Walks (amount, in unit steps) charges; the total, or the error of the first that does not fit."""
        used = 0
        for amount, units in charges:
            if units and amount == 0:
                continue
            self.check(used)
            if used + amount > self.work_limit:
                raise WorkLimitExceeded(self.work_limit, self.work_limit if units else used)
            used += amount
        return used


def outcome(charges: list[tuple[int, bool]], limit: int) -> tuple[bool, int]:
    """(complete, consumed) under a limit."""
    try:
        return True, ExecutionControl(limit).admit(charges)
    except WorkLimitExceeded as e:
        return False, e.consumed


def radix_charges(r: int) -> list[tuple[int, bool]]:
    b = RADIX_BUCKETS
    return [] if r < 2 else [(r + b, False), *([(b, False), (r, False)] * 12), (r, False)]


def decomposition_charges(v: int, e: int, c: int, r: int, q: int) -> list[tuple[int, bool]]:
    """Vertices, edges, components, cross-component edges before and after dedup."""
    partition = [(3 * v, False), (4 * v + e, True), (c, False), (v, True), (c + 1, False), (v, False), (c, False), (v, True)]
    return [*partition, (e, True), *radix_charges(r), (2 * c + 2, False), (q, False), (2 * c, False), (q, False), (q, False), (c, False)]


def schedule_charges(c: int, q: int, w: int) -> list[tuple[int, bool]]:
    return [(c, False), (c, False), (c + q, True), (w + 1, False), (c, False), (w, False), (c, False), (c, False), (w, False)]


def traversal_charges(vertices: int, edges: int) -> list[tuple[int, bool]]:
    """Reached vertices and their out-edges."""
    return [(vertices + edges, True)]
