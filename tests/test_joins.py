"""Components, ranks, levels and lookups by joins: rounds, equality with the sequential helpers, giant parts and hubs."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from arcwave import errors as E
from arcwave.control import ExecutionControl
from arcwave.graph import Graph
from arcwave.operators import joins, levels, parts
from arcwave.operators.condensation import Condensation
from arcwave.operators.schedule import schedule
from arcwave.operators.scc import decompose, regrouped
from arcwave.operators.traversal import Bitmaps, breadth_first, levels_from
from arcwave.plans import lineage
from arcwave.sources import datasource, snapshot, tables


def dense(spark, n, pairs):
    return Graph.from_dense_edges(spark, n, spark.createDataFrame(list(pairs) or [(0, 0)], "a bigint, b bigint"))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def mixed(seed, n=90):
    """Chains, cycles, trees and a random middle, under shuffled names."""
    rng = random.Random(seed)
    pairs = [(k, k + 1) for k in range(20)] + [(k, k + 1) for k in range(30, 40)] + [(40, 30), (35, 3)]
    pairs += [(rng.randrange(45, 75), rng.randrange(45, 75)) for _ in range(45)] + [(k, rng.randrange(45, n)) for k in range(75, n)]
    names = list(range(n))
    rng.shuffle(names)
    return [(names[a], names[b]) for a, b in pairs]


@pytest.mark.parametrize("seed", [1])
def test_joins_agree_with_the_helper(spark, seed):
    g = dense(spark, 90, mixed(seed))
    want = decompose(g, "local")
    for found in (decompose(g, "distributed"),):
        assert same(want.membership, found.membership) and same(want.components, found.components) and same(want.condensation.edges, found.condensation.edges)
        assert found.rounds.total > 0
    s = want.condensation.schedule("local")
    assert same(s.table, want.condensation.schedule("distributed").table)


@pytest.mark.parametrize("closed", [False, True])
def test_rounds_of_a_deep_graph(spark, closed):
    n = 20_000
    g = Graph.from_dense_edges(spark, n, spark.range(n if closed else n - 1).select("id", ((F.col("id") + 1) % n).alias("b")))
    d = decompose(g, "distributed")
    assert d.component_count == (1 if closed else n)
    assert d.rounds.total <= 2 + 15 + 15  # two contractions, and doublings of log2(n)
    if not closed:
        s = d.condensation.schedule("distributed")
        assert s.rounds.total < 40 and s.wave_count == n
        assert s.table.filter("rank <> component or topo_pos <> component").isEmpty()


@pytest.mark.parametrize("seed", [3])
def test_orders_by_levels_and_by_doubling(spark, seed):
    rng = random.Random(seed)
    names = list(range(60))
    rng.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(140)}]
    c = Condensation(spark.createDataFrame(pairs, "src bigint, dst bigint"), 60, len(pairs))
    want = schedule(c, "local")
    ranks = want.table.select(F.col("component").alias("v"), "rank")
    found = levels.longest_ranks(c.edges, 60)
    assert same(found, ranks.filter("rank > 0"))
    for deep in (0, 10_000):
        order = levels.queue_order(c.edges, ranks, want.wave_count, deep=deep)
        assert same(order.select("v", "pos"), want.table.select(F.col("component").alias("v"), F.col("topo_pos").alias("pos")))


def test_a_cycle_has_no_ranks(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (0, 4)], "src bigint, dst bigint")
    with pytest.raises(E.CondensationCycle):
        levels.longest_ranks(pairs, 5)
    more = spark.createDataFrame([(0, 9), (9, 1), (1, 2), (2, 9), (0, 1), (0, 2)], "src bigint, dst bigint")
    with pytest.raises(E.CondensationCycle):
        levels.longest_ranks(more, 10)


def test_levels_take_fewer_plans(spark):
    order, count, plans = levels_from(tables.chain(spark, 20), 0)
    assert (count, plans, order.count()) == (20, 4, 20)
    g = dense(spark, 70, [(random.Random(8).randrange(70), k) for k in range(70)] + [(k, (k * 3 + 1) % 70) for k in range(0, 70, 2)])
    for start in (0,):
        assert same(breadth_first(g, start, strategy="local"), breadth_first(g, start, strategy="distributed"))


def test_bitmaps_hold_what_was_added(spark):
    ids = [0, 1, 7, 8, 32_766, 32_767, 32_768, 65_535, 65_536, 1_000_000, 4_294_967_294]
    seen = Bitmaps(10)
    seen.add(spark.createDataFrame([(i,) for i in ids[::2]], "dense bigint"))
    seen.add(spark.createDataFrame([(i,) for i in ids[1::4]], "dense bigint"))
    held = set(ids[::2]) | set(ids[1::4])
    asked = ids + [i + 1 for i in ids]
    marked = seen.marked(spark.createDataFrame([(i, "x") for i in [*asked, None]], "dst bigint, key string"))
    assert sorted(map(str, marked.select("dst", "__seen").collect())) == sorted(map(str, spark.createDataFrame([(i, i in held) for i in [*asked, None]], "dst bigint, __seen boolean").collect()))
    assert seen.table.df.count() == 5 and marked.columns == ["dst", "key", "__seen"]


def test_small_parts_share_batches(spark):
    """600 parts of 2 edges and a giant one: the giant part goes to joins, the others to a few batches."""
    giant = [(k, (k * 7 + 1) % 200) for k in range(200)] + [(k, k + 1) for k in range(199)]
    small = [(200 + 3 * k + a, 200 + 3 * k + b) for k in range(600) for a, b in ((0, 1), (1, 0))]
    g = dense(spark, 2000, giant + small)
    found = parts.parted(g.edges, g.edge_count, 100)
    assert found.large is not None and same(found.large, g.edges.filter("src < 200"))
    assert 2 <= found.batches.select("part").distinct().count() <= 20
    assert found.batches.count() == 1200
    assert same(decompose(g, part_edges=100).membership, decompose(g, "local").membership)


def test_a_hub_is_no_window(spark):
    n = 3000
    g = Graph.from_dense_edges(spark, n, spark.range(1, n).select(F.lit(0).cast("bigint").alias("a"), "id"))
    rows = g.adjacency()
    assert rows.filter("pos <> dst - 1").isEmpty() and rows.count() == n - 1
    plan = rows._jdf.queryExecution().toString() + decompose(g, "distributed").fibers()._jdf.queryExecution().toString()
    assert "partitionBy" not in plan and "windowspecdefinition(src" not in plan and "windowspecdefinition(component" not in plan


# lookups


def scanned(df):
    """The rows that the scans of a plan without shuffles gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_read_a_page(spark):
    n = 120_000
    g = Graph.from_dense_edges(spark, n, spark.range(n * 2).select((F.col("id") % n).alias("a"), ((F.col("id") * 31 + 5) % n).alias("b")))
    ready = g.indexed()
    for v in (7, n - 1):
        assert same(g.successors(v), ready.successors(v)) and same(g.predecessors(v), ready.predecessors(v))
        assert not ready.successors(v).isEmpty()
        assert scanned(ready.index.by_src.filter(F.col("src") == v)) <= 4 * lineage.PAGE_ROWS < g.edge_count / 10
        assert scanned(ready.index.by_dst.filter(F.col("dst") == v)) <= 4 * lineage.PAGE_ROWS
        assert ready.stable_id(v) == v and ready.dense_id(v) == v
    assert scanned(g.edges.filter(F.col("src") == 7)) > 4 * lineage.PAGE_ROWS  # what sorting is for
    assert ready.contains_edge(7, (7 * 31 + 5) % n) and not ready.contains_edge(7, 8)
    d = decompose(dense(spark, 6, [(0, 1), (1, 0), (5, 2)]))
    q = d.indexed()
    assert q.component_of(5) == d.component_of(5) and same(q.fiber(d.component_of(5)), d.fiber(d.component_of(5)))
    assert q.component(0) == d.component(0)


# the data source


def test_snapshot_source_round_trip(spark, tmp_path):
    g = dense(spark, 40, mixed(6, 90)[:0] + [(k % 40, (k * k + 3) % 40) for k in range(150)])
    profile, path = bytes(range(32)), str(tmp_path / "s")
    datasource.write_snapshot(g, path, profile)
    for step in (100, 1 << 20):
        back = datasource.read_snapshot(spark, path, profile, bytes_a_task=step)
        assert same(back.edges, g.edges) and back.vertex_count == 40 and not back.has_reverse
    words = spark.read.format(datasource.NAME).option("path", path).option("profile", profile.hex()).option("bytes_a_task", "100").load()
    assert words.rdd.getNumPartitions() == -(-snapshot.payload_length(40, g.edge_count) // 100)
    held = datasource.SnapshotReader({"path": path, "profile": profile.hex()})
    assert b"".join((tmp_path / "s" / p["name"]).read_bytes() for p in held.parts) == snapshot.encode_snapshot(g, profile)
    with pytest.raises(E.SnapshotError, match="Profile"):
        datasource.read_snapshot(spark, path, bytes(32))
    with pytest.raises(E.SnapshotError, match="EdgeLimit"):
        datasource.read_snapshot(spark, path, profile, snapshot.SnapshotLimits(max_edges=3))
    with pytest.raises(Exception, match="FileExists"):
        datasource.write_snapshot(g, path, profile)
    smaller = dense(spark, 3, [(0, 1)])
    datasource.write_snapshot(smaller, path, profile, overwrite=True)
    assert same(datasource.read_snapshot(spark, path, profile).edges, smaller.edges)


def test_snapshot_source_shows_all_or_nothing(spark, tmp_path):
    spark.dataSource.register(datasource.SnapshotSource)
    profile = bytes(32).hex()
    out = lambda df, path: df.write.format(datasource.NAME).option("profile", profile).option("vertices", 2).option("edges", 1).mode("append").save(path)
    words = lambda *rows: spark.createDataFrame(rows, "pos bigint, word bigint").coalesce(1)
    for k, bad in enumerate([words((0, 0), (1, 1), (2, 1)), words((0, 0), (2, 1), (3, 1)), words((0, 0), (1, 1), (2, 1), (3, 1 << 32))]):
        path = str(tmp_path / f"bad{k}")
        with pytest.raises(Exception):
            out(bad, path)
        with pytest.raises(E.SnapshotError):
            datasource.read_snapshot(spark, path, bytes(32))
    out(words((0, 0), (1, 1), (2, 1), (3, 1)), str(tmp_path / "good"))
    assert [tuple(r) for r in datasource.read_snapshot(spark, str(tmp_path / "good"), bytes(32)).edges.collect()] == [(0, 1)]


# control


def written(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lineage.shared_dir(spark))
    return {str(s.getPath()) for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}


def test_a_running_job_is_interrupted(spark):
    g = tables.chain(spark, 400_000)
    before, event, started = written(spark), threading.Event(), time.time()
    threading.Timer(4, event.set).start()
    with pytest.raises(E.Cancelled):
        decompose(g, "distributed", ExecutionControl().with_cancellation(event))
    assert time.time() - started < 12
    assert written(spark) == before
    assert spark.range(10).count() == 10  # later jobs run


def test_tables_of_a_decomposition(spark):
    g = dense(spark, 90, mixed(7))
    before = written(spark)
    d = decompose(g, "distributed")
    assert len(written(spark) - before) == 3  # membership, components, quotient
    s = d.condensation.schedule("distributed")
    assert len(written(spark) - before) == 4 and s.table.count() == d.component_count


# certificates


def test_merged_components_are_noticed(spark):
    d = decompose(dense(spark, 6, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (4, 5)]))
    d.validate()
    merged = regrouped(d, d.membership.select("dense", F.when(F.col("dense") < 4, 0).otherwise(F.col("dense")).cast("bigint").alias("component")))
    assert [tuple(r) for r in merged.unconnected().collect()] == [(0, 2, 0)]  # 0 and 1 are not reached from 3
    with pytest.raises(E.InvalidPartition, match="strongly connected"):
        merged.validate()


def test_fingerprints_tell_graphs_apart(spark):
    a, b = dense(spark, 5, [(0, 1), (1, 2)]), dense(spark, 5, [(1, 2), (0, 1), (0, 1)])
    assert a.same_as(b) and not a.same_as(dense(spark, 5, [(0, 1), (2, 1)])) and not a.same_as(dense(spark, 6, [(0, 1), (1, 2)]))


def test_long_conversations_keep_their_turns(spark, tmp_path):
    spark.createDataFrame([(1, 1000, "u", "a"), (2, 0, "u", "b"), (2, 1, "a", "c")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    g = tables.graph(tables.dialogue(spark, str(tmp_path)))
    assert (g.vertex_count, g.edge_count) == (3, 1)
