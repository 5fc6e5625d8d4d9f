"""User functions over the waves of a schedule: one call a component, once all its predecessors are done.

Waves are independent of each other only from one to the next, but most are small. Consecutive small waves form a band of about ``BAND``
components, and a band is one task: its components in the order (wave, id). A wave of over ``BAND`` components is a band of its own, dealt over tasks, as
it has no edges inside. So there are about components / ``BAND`` jobs instead of one a wave.

Only the calls go band after band. Before the first one, one job over all bands lays out each component with its payload and the ids of its predecessors, a
folder a band, and lists the predecessors that stand in other bands. A band reads its own folder, and of earlier bands no values but those on this list:
from the bands of the last ``WINDOW`` it reads those that hold some, and older ones have sent theirs, in a table sorted by the band that they are for. So
a value is written once, and again at every ``WINDOW`` bands while a band to come needs it. A lost executor costs its tasks of the running band.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arcwave.operators.condensation import Condensation
from arcwave.operators.schedule import Schedule
from arcwave.plans.lineage import Scope, Table, sorted_table
from arcwave.plans.spread import BROADCAST_ROWS

#: Components that one task takes: some hundred MB of Python values.
BAND = 500_000
#: Bands whose values are read where they were written; older ones send what is needed later.
WINDOW = 16

#: Takes a component's id, its payload (a dict, or None) and the (id, value) of its predecessors, ascending; gives its value.
Step = Callable[[int, dict | None, list[tuple[int, Any]]], Any]


def _starts(s: Schedule, band: int) -> list[tuple[int, int, int]]:
    """(first position, position behind, tasks) of each band: two rows at most for each ``band`` positions.

    A band starts with the first wave that starts at or behind a multiple of ``band``, and a wave of over ``band`` components is one. So only
    the waves that hold both sides of a multiple have to be measured.
    """
    cells = s.table.groupBy(F.expr(f"wave_pos div {band}").alias("cell")).agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("wave_pos").alias("last")).orderBy("cell").collect()
    if not cells:
        return []
    count, across = cells[-1]["last"] + 1, sorted({b["low"] for a, b in zip(cells, cells[1:]) if a["high"] == b["low"]})
    found = []
    if across:
        ranks = s.table.sparkSession.createDataFrame([(r,) for r in across], "rank bigint")
        sizes = s.table.join(F.broadcast(ranks) if len(across) <= BROADCAST_ROWS else ranks, "rank").groupBy("rank").agg(F.min("wave_pos").alias("start"), F.count(F.lit(1)).alias("size"))
        found = [(r["start"], r["start"] + r["size"]) for r in sizes.collect()]
    large = {a: b for a, b in found if b - a > band}
    inside = {m: b for a, b in found for m in range((a // band + 1) * band, b, band)}
    firsts = {inside.get(m, m) for m in range(0, count, band)} | set(large) | set(large.values())
    firsts = sorted(f for f in firsts if f < count)
    return [(a, b, -(-(b - a) // band) if a in large else 1) for a, b in zip(firsts, [*firsts[1:], count])]


def banded(s: Schedule, band: int = BAND) -> tuple[DataFrame, int]:
    """((component, rank, band, task), the number of bands): waves of up to ``band`` components share bands of at most twice as many."""
    members, starts = _banded(s, band)
    return members, len(starts)


def _banded(s: Schedule, band: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    starts = _starts(s, band)
    rows = [(m, k, a, b, tasks) for k, (a, b, tasks) in enumerate(starts) for m in range(a // band, (b - 1) // band + 1)]
    places = s.table.sparkSession.createDataFrame(rows, "cell bigint, band bigint, start bigint, end bigint, tasks bigint")
    places = F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places
    met = s.table.withColumn("cell", F.expr(f"wave_pos div {band}")).join(places, "cell").filter("wave_pos >= start and wave_pos < end")
    task = F.when(F.col("tasks") > 1, F.pmod(F.xxhash64("component"), F.col("tasks"))).otherwise(0).cast("bigint")
    return met.select("component", "rank", "band", task.alias("task")), starts


def evaluate(c: Condensation, s: Schedule, payload: DataFrame, step: Step, kind: str, band: int = BAND) -> tuple[DataFrame, int]:
    """((component, value) of every component, the number of bands); ``payload`` has a row at most for each (component, more columns), ``kind`` is the value's type."""
    spark, inner_kind = s.table.sparkSession, T._parse_datatype_string(kind)
    result = T.StructType([T.StructField("component", T.LongType()), T.StructField("value", inner_kind)])
    with Scope() as scope:
        members, starts = _banded(s, band)
        if not starts:
            return scope.keep(spark.createDataFrame([], result)), 0
        names = [x for x in payload.columns if x != "component"]
        own = [f"own_{n}" for n in range(len(names))]
        laid, needed, pairs = _laid(c, members, payload.select("component", *[F.col(x).alias(o) for x, o in zip(names, own, strict=True)]), own)
        run = _band(step, names, to_arrow_type(inner_kind))
        done: list[Table] = []
        sent: DataFrame | None = None
        first = 0  # of the bands whose values are read where they were written
        held = lambda tables: spark.read.schema(result).parquet(*[t.path for t in tables])
        for k, (_, _, tasks) in enumerate(starts):
            rows = laid.filter(F.col("band") == k).select("task", "rank", "component", *own, "before", F.lit(None).cast(inner_kind).alias("value"))
            met = []
            if givers := [done[j] for j in range(first, k) if k in pairs[j]]:
                met.append(held(givers).join(needed.filter((F.col("band") == k) & (F.col("giver") >= first)), "component"))
            if sent is not None and any(k in pairs[j] for j in range(first)):
                met.append(sent.filter(F.col("band") == k))
            for values in met:
                rows = rows.unionByName(values.select("task", "component", "value"), allowMissingColumns=True)
            rows = rows.coalesce(1) if tasks == 1 else rows.repartition(tasks, "task")
            done.append(Table(rows.mapInArrow(run, result)))
            if k + 1 - first >= WINDOW:
                late = []
                if givers := [done[j] for j in range(first, k + 1) if any(b > k for b in pairs[j])]:
                    late.append(held(givers).join(needed.filter((F.col("band") > k) & F.col("giver").between(first, k)), "component").select("band", "task", "component", "value"))
                if sent is not None and any(b > k for j in range(first) for b in pairs[j]):
                    late.append(sent.filter(F.col("band") > k))
                sent = sorted_table(reduce(DataFrame.unionByName, late), ("band", "component")) if late else None
                first = k + 1
        for t in done:
            scope.keep(t.df)
        return held(done), len(starts)


def _laid(c: Condensation, members: DataFrame, given: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame | None, dict[int, set[int]]]:
    """What bands read, in written tables: (band, task, rank, component, own..., before) of every component; (giver, component, band, task), which
    component's value what other task needs, None if none does; and for each giving band the bands that it gives to."""
    dealt = members.join(given, "component", "left").select("band", "task", "rank", "component", *own)
    into = c.edges.join(members.select(F.col("component").alias("dst"), F.col("band").alias("to_band"), F.col("task").alias("to_task")), "dst").select("to_band", "to_task", "dst", "src")
    lists = [T.StructField(x, T.ArrayType(T.LongType())) for x in ("before", "outer")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema.fields] + lists)
    laid = Table(dealt.groupBy("band", "task").cogroup(into.groupBy("to_band", "to_task")).applyInArrow(_lay, schema), {"outer": F.sum(F.size("outer"))}, ("band",))
    pairs: dict[int, set[int]] = defaultdict(set)
    if not laid.seen["outer"]:
        return laid.df, None, pairs
    asked = laid.df.filter(F.size("outer") > 0).select("band", "task", F.explode("outer").alias("component")).distinct()
    asked = F.broadcast(asked) if laid.seen["outer"] <= BROADCAST_ROWS else asked
    needed = sorted_table(members.select("component", F.col("band").alias("giver")).join(asked, "component").select("giver", "band", "task", "component"), ("band", "giver", "component"))
    for r in needed.select("giver", "band").distinct().collect():  # at most the square of the number of bands
        pairs[r["giver"]].add(r["band"])
    return laid.df, needed, pairs


def _lay(members: pa.Table, edges: pa.Table) -> pa.Table:
    """The components of a task in their order, each with its predecessors, ascending, and those of them that are not in the task."""
    members = members.sort_by([("rank", "ascending"), ("component", "ascending")])
    at, src, dst = members.column("component").to_numpy(), edges.column("src").to_numpy(), edges.column("dst").to_numpy()
    order = np.lexsort((src, dst))
    src, dst, held = src[order], dst[order], np.sort(at)
    firsts, ends = np.searchsorted(dst, at, "left"), np.searchsorted(dst, at, "right")
    offsets = np.concatenate([[0], np.cumsum(ends - firsts)])
    src = src[np.repeat(firsts - offsets[:-1], ends - firsts) + np.arange(offsets[-1])]
    outer = held[np.minimum(np.searchsorted(held, src), len(held) - 1)] != src
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))
    members = members.append_column("before", lists(offsets, src))
    return members.append_column("outer", lists(np.concatenate([[0], np.cumsum(outer)])[offsets], src[outer]))


def _listed(column: pa.ChunkedArray) -> list:
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _band(step: Step, names: list[str], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(found) if (found := list(batches)) else None
        if rows is None:
            return
        given = rows.filter(rows.column("before").is_null())
        members = rows.filter(rows.column("before").is_valid()).sort_by([("rank", "ascending"), ("component", "ascending")])
        before = members.column("before").combine_chunks()
        ends, seen = np.cumsum(before.value_lengths().to_numpy()).tolist(), before.flatten().to_numpy()
        at = np.concatenate([members.column("component").to_numpy(), given.column("component").to_numpy()])
        order = np.argsort(at)
        places = order[np.minimum(np.searchsorted(at, seen, sorter=order), len(at) - 1)]  # of predecessors, in the list of values
        if (at[places] != seen).any():
            raise ValueError("a predecessor has no value yet")
        places, seen = places.tolist(), seen.tolist()
        values = [None] * members.num_rows + _listed(given.column("value"))
        payload = [_listed(members.column(f"own_{n}")) for n in range(len(names))]
        ids, first, columns = _listed(members.column("component")), 0, list(zip(names, payload, strict=True))
        for k, end in enumerate(ends):
            mine = {x: column[k] for x, column in columns} if columns else None
            if end - first == 1:
                values[k] = step(ids[k], mine, [(seen[first], values[places[first]])])
            else:
                values[k] = step(ids[k], mine, [(x, values[p]) for x, p in zip(seen[first:end], places[first:end], strict=True)])
            first = end
        out = values[: len(ids)]
        yield from pa.table({"component": pa.array(ids, pa.int64()), "value": pa.array(out, kind)}).to_batches()

    return run
