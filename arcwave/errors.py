"""Typed failures: malformed graphs, exhausted budgets, malformed snapshots. Equal fields make equal errors."""

from __future__ import annotations

from dataclasses import dataclass, fields


class ArcwaveError(Exception):
    """Base of all errors; ``str`` lists the fields."""

    def __str__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{f.name}={getattr(self, f.name)!r}' for f in fields(self))})"


class GraphError(ArcwaveError):
    """A graph, or an identifier into one, is invalid."""


@dataclass(unsafe_hash=True)
class VertexInputLimitExceeded(GraphError):
    limit: int


@dataclass(unsafe_hash=True)
class EdgeInputLimitExceeded(GraphError):
    limit: int


@dataclass(unsafe_hash=True)
class VertexDomainOverflow(GraphError):
    count: int


@dataclass(unsafe_hash=True)
class EdgeDomainOverflow(GraphError):
    count: int


@dataclass(unsafe_hash=True)
class UnknownEndpoint(GraphError):
    edge_index: int
    endpoint: str


@dataclass(unsafe_hash=True)
class StableNodeOrder(GraphError):
    index: int


@dataclass(unsafe_hash=True)
class OffsetLength(GraphError):
    direction: str
    expected: int
    actual: int


@dataclass(unsafe_hash=True)
class OffsetOrigin(GraphError):
    direction: str
    actual: int | None


@dataclass(unsafe_hash=True)
class OffsetOrder(GraphError):
    direction: str
    index: int
    previous: int
    next: int


@dataclass(unsafe_hash=True)
class OffsetTerminal(GraphError):
    direction: str
    expected: int
    actual: int


@dataclass(unsafe_hash=True)
class TargetOutOfRange(GraphError):
    direction: str
    edge_index: int
    target: int
    vertex_count: int


@dataclass(unsafe_hash=True)
class AdjacencyOrder(GraphError):
    direction: str
    source: int
    edge_index: int
    previous: int
    next: int


@dataclass(unsafe_hash=True)
class ReverseEdgeCount(GraphError):
    forward: int
    reverse: int


@dataclass(unsafe_hash=True)
class ReverseEdgeMissing(GraphError):
    source: int
    target: int


@dataclass(unsafe_hash=True)
class DenseIdOutOfRange(GraphError):
    id: int
    vertex_count: int


@dataclass(unsafe_hash=True)
class ComponentIdOutOfRange(GraphError):
    id: int
    component_count: int


@dataclass(unsafe_hash=True)
class InvalidPartition(GraphError):
    reason: str


@dataclass(unsafe_hash=True)
class CondensationCycle(GraphError):
    pass


@dataclass(unsafe_hash=True)
class RankOverflow(GraphError):
    pass


@dataclass(unsafe_hash=True)
class GroupTooLarge(GraphError):
    """An inherently sequential order was asked of a connected part that is over the stated bound of one task."""

    edges: int
    bound: int


class Incomplete(ArcwaveError):
    """A run stopped before it had an answer; there is no partial one."""


@dataclass(unsafe_hash=True)
class WorkLimitExceeded(Incomplete):
    limit: int
    consumed: int


@dataclass(unsafe_hash=True)
class Cancelled(Incomplete):
    consumed: int


@dataclass(unsafe_hash=True)
class SnapshotError(ArcwaveError):
    """A byte snapshot is refused; ``kind`` names the gate."""

    kind: str
