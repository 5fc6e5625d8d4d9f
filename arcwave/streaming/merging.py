"""Components of a stream of edges that belong to parts (users, sessions, tenants), merged in keyed state.

    query = keep(edges, store, checkpoint)               # a stream of (part, src, dst)
    labels(spark.read.parquet(store)).filter("part = 7")  # (part, vertex, component, size), at any time

Edges only come, never go, and join their ends whatever their direction. The state of a part holds each vertex (its root, and
the next vertex of its component's circle) and each root (least member, size), in pages, a row of the RocksDB state store each. An edge
between two components gives the members of the smaller one a new root and splices the circles, so a vertex changes its root log2(size) times
at most, and a batch costs its edges and the pages of the vertices that change, not the graph. What changed is the
output; a component is named by its least vertex, which only its root's row has to know.

Ends are integers or strings. An edge with one null end makes the other a vertex; edges without part or without ends are dropped;
repeated edges and loops change nothing. Before the shuffle each task drops the edges of an Arrow batch that others of the batch
imply, so a part that holds most rows sends its task a forest of each batch only; its state is still kept by one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_ROWS = 10_000
#: Vertices of a page of a part's state, on average at most.
PAGE = 4_096


class _Pages:
    """A part's vertices, (root, next) each, and its roots, (least, size) each, in pages that one state row holds as JSON.

    A part has one page until it holds ``PAGE`` vertices, then four times as many whenever pages hold more than that on average. Pages that a
    batch touches are read once and written once, so a batch costs a few calls of the state store and not some for each vertex.
    """

    def __init__(self, state: Any, pages: int, count: int) -> None:
        self.state, self.pages, self.count = state, pages, count
        self.held: dict[int, tuple[dict, dict]] = {}
        self.dirty: set[int] = set()

    def _place(self, v: Any) -> int:
        return zlib.crc32(str(v).encode()) % self.pages if self.pages > 1 else 0

    def _page(self, at: int) -> tuple[dict, dict]:
        if at not in self.held:
            row = self.state.getValue((at,))
            lists = json.loads(row[0]) if row is not None else [[]] * 6
            self.held[at] = tuple(dict(zip(k, zip(x, y, strict=True), strict=True)) for k, x, y in (lists[:3], lists[3:]))
        return self.held[at]

    def node(self, v: Any) -> tuple | None:
        return self._page(self._place(v))[0].get(v)

    def root(self, v: Any) -> tuple | None:
        return self._page(self._place(v))[1].get(v)

    def put_node(self, v: Any, row: tuple) -> None:
        at = self._place(v)
        nodes = self._page(at)[0]
        self.count += v not in nodes
        nodes[v] = row
        self.dirty.add(at)

    def put_root(self, v: Any, row: tuple | None) -> None:
        at = self._place(v)
        roots = self._page(at)[1]
        if row is None:
            del roots[v]
        else:
            roots[v] = row
        self.dirty.add(at)

    def flush(self) -> None:
        before = self.pages
        while self.count > self.pages * PAGE:
            self.pages *= 4
        if self.pages > before:
            kept: dict[int, tuple[dict, dict]] = {}
            for at in range(before):  # a page's vertices go to pages of their own, so one after another is split; those not touched are not kept
                touched = at in self.held
                old = self._page(at)
                split: dict[int, tuple[dict, dict]] = {new: ({}, {}) for new in range(at, self.pages, before)}
                for kind, rows in enumerate(old):
                    for v, row in rows.items():
                        split[self._place(v)][kind][v] = row
                self.held.pop(at)
                for new, page in split.items():
                    self._write(new, page)
                    if touched:
                        kept[new] = page
            self.held = kept
        else:
            for at in self.dirty:
                self._write(at, self.held[at])

    def _write(self, at: int, page: tuple[dict, dict]) -> None:
        lists = [column for rows in page for column in (list(rows), *([row[k] for row in rows.values()] for k in (0, 1)))]
        self.state.updateValue((at,), (json.dumps(lists, separators=(",", ":")),))


class Merge(StatefulProcessor):
    """One part's components; gives (part, vertex, root, least, size, turn) for every vertex whose root, or whose component as a root, changed."""

    def __init__(self, vertex: DataType) -> None:
        self.vertex = vertex

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", StructType([StructField("page", LongType())]), StructType([StructField("rows", StringType())]))
        self.turn = handle.getValueState("turn", StructType([StructField(c, LongType()) for c in ("n", "pages", "vertices")]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        turn, pages, count = self.turn.get() or (0, 1, 0)
        held, changed = _Pages(self.pages, pages, count), set()

        def root_of(v: Any) -> Any:
            row = held.node(v)
            if row is None:
                held.put_node(v, (v, v))
                held.put_root(v, (v, 1))
                changed.add(v)
                return v
            return row[0]

        for chunk in rows:
            for a, b in zip(chunk["src"].tolist(), chunk["dst"].tolist(), strict=True):
                big, few = root_of(a), root_of(b)
                if big == few:
                    continue
                if held.root(big)[1] < held.root(few)[1]:
                    big, few = few, big
                (least, size), (other, members) = held.root(big), held.root(few)
                v = few
                while True:
                    after = held.node(v)[1]
                    held.put_node(v, (big, after))
                    changed.add(v)
                    v = after
                    if v == few:
                        break
                ends = held.node(big)[1], held.node(few)[1]
                held.put_node(big, (big, ends[1]))
                held.put_node(few, (big, ends[0]))
                held.put_root(big, (min(least, other), size + members))
                held.put_root(few, None)
                changed.add(big)
        turn += 1
        held.flush()
        self.turn.update((turn, held.pages, held.count))
        found = list(changed)
        for k in range(0, len(found), OUT_ROWS):
            part = found[k : k + OUT_ROWS]
            tops = [held.node(v)[0] for v in part]
            least, size = zip(*(held.root(r) for r in tops), strict=True)
            yield pd.DataFrame({"part": [key[0]] * len(part), "vertex": part, "root": tops, "least": least, "size": size, "turn": [turn] * len(part)})

    def close(self) -> None:
        pass


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of each batch that join what earlier ones of the batch did not, and each vertex once."""
    for batch in batches:
        up: dict[tuple, tuple] = {}

        def top(x: tuple) -> tuple:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        take = []
        for part, a, b in zip(batch["part"].tolist(), batch["src"].tolist(), batch["dst"].tolist(), strict=True):
            ends = [(part, a), (part, b)]
            fresh = any(x not in up for x in ends)
            for x in ends:
                up.setdefault(x, x)
            x, y = map(top, ends)
            up[x] = y
            take.append(fresh or x != y)
        yield batch[take]


def changes(edges: DataFrame) -> DataFrame:
    """The stream of changes of a stream whose first three columns are a part and the ends of an edge."""
    part, src, dst = edges.columns[:3]
    rows = edges.select(F.col(part).alias("part"), F.coalesce(src, dst).alias("src"), F.coalesce(dst, src).alias("dst")).filter("part is not null and src is not null")
    kind = {f.name: f.dataType for f in rows.schema}
    out = StructType([StructField("part", kind["part"]), *(StructField(c, kind["src"]) for c in ("vertex", "root", "least")), StructField("size", LongType()), StructField("turn", LongType())])
    return rows.mapInPandas(_forest, rows.schema).groupBy("part").transformWithStateInPandas(Merge(kind["src"]), out, "Update", "None")


def keep(edges: DataFrame, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the query that writes the changes of each batch to a folder of its own in ``store``; a batch that is run again replaces its rows."""
    spark = edges.sparkSession

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = changes(edges).writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it was started with
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)


def labels(stored: DataFrame) -> DataFrame:
    """(part, vertex, component, size) from all changes so far: a vertex's last root, and that root's last least member."""
    last = stored.groupBy("part", "vertex").agg(F.max_by(F.struct("root", "least", "size"), "turn").alias("x")).select("part", "vertex", "x.*")
    tops = last.filter("vertex = root").select("part", "root", F.col("least").alias("component"), "size")
    return last.select("part", "vertex", "root").join(tops, ["part", "root"]).select("part", "vertex", "component", "size")
