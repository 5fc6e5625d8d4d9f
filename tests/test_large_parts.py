"""What happens to parts, paths and streams over the bounds of one task, and what goes through the driver meanwhile."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from arcwave.graph import Graph
from arcwave.operators import bands, joins, levels, parts, scc, traversal
from arcwave.operators.condensation import Condensation
from arcwave.operators.parts import parted, part_of
from arcwave.operators.schedule import longest_paths, schedule
from arcwave.plans.lineage import Table


def last_plan(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription()


def test_written_joins_are_not_broadcast(spark):
    """A side of some hundred KB is under Spark's own bound of 10 MB, so each round of joins would send it through the driver."""
    rows = lambda salt: spark.range(60_000).select(F.xxhash64("id").alias("k"), F.xxhash64("id", F.lit(salt)).alias("v"))
    left, right = Table(rows(1)).df, Table(rows(2).withColumnRenamed("v", "w")).df
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    both = Table(left.join(right, "k"), {"n": F.count(F.lit(1))})
    assert both.seen["n"] == 60_000
    assert "BroadcastExchange" not in last_plan(spark) and "SortMergeJoin" in last_plan(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    Table(left.join(F.broadcast(right), "k"))  # a hint still counts
    assert "BroadcastExchange" in last_plan(spark)


def test_depth_first_orders_of_parts_over_the_bound(spark, monkeypatch):
    """A part of any size is walked whole; such parts used to be refused by an error."""
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(150)] + [(60 + rng.randrange(50), 60 + rng.randrange(50)) for _ in range(120)] + [(112, 113), (114, 114)]
    g = Graph.from_dense_edges(spark, 120, spark.createDataFrame(pairs, "s bigint, t bigint"))
    tree = lambda: sorted(map(tuple, traversal.depth_first(g, 7).collect()))
    forest = lambda: sorted(map(tuple, traversal.depth_first_forest(g).collect()))
    want = tree(), forest()
    monkeypatch.setattr(traversal, "PART_EDGES", 50)
    monkeypatch.setattr(traversal, "OUT_ROWS", 16)
    monkeypatch.setattr(traversal, "parted", lambda edges, n: parted(edges, n, 50))
    monkeypatch.setattr(traversal, "part_of", lambda edges, n, v: part_of(edges, n, v, 50))
    assert len(want[1]) == 120 and (tree(), forest()) == want


def test_chains_trees_and_cycles_by_rulers(spark):
    """Pointers followed over several levels of rulers, and in one task."""
    rng = random.Random(2)
    links = [(k, rng.randrange(k)) for k in range(1, 300)]  # a tree with root 0, which has no link
    names = list(range(1000, 1400))
    rng.shuffle(names)
    links += list(zip(names, names[1:]))  # a chain
    ring = list(range(2000, 2200))
    rng.shuffle(ring)
    links += list(zip(ring, ring[1:] + ring[:1])) + [(3000, 3001), (3001, 3000)]
    up = dict(links)

    def followed(v):
        way = [v]
        while up[way[-1]] in up and up[way[-1]] not in way:
            way.append(up[way[-1]])
        return (v, way[-1], True, len(way)) if up[way[-1]] not in up else (v, min(way), False, None)

    frame = spark.createDataFrame([(a, b, 1, a, a) for a, b in links], "v bigint, nxt bigint, d bigint, least bigint, tail bigint")
    for core in (10, 10_000):
        rounds = joins.Rounds()
        rows = joins.chained(frame, rounds, core).collect()
        assert sorted((r["v"], r["last"] if r["ended"] else r["least"], r["ended"], r["d"] if r["ended"] else None) for r in rows) == sorted(map(followed, up))
        assert core > 10 or rounds.double > 8


def test_a_path_is_named_without_doubling(spark):
    """Each rank has one vertex, so no sequence has to be compared: log2(length) sorts of all vertices before."""
    rounds = joins.Rounds()
    path = spark.range(300).select("id", F.xxhash64("id").alias("v")).select("v", F.col("id").alias("rank"), F.xxhash64(F.when(F.col("id") > 0, F.col("id") - 1)).alias("up"))
    path = path.withColumn("up", F.when(F.col("rank") > 0, F.col("up")))
    assert levels.named(path, 300, rounds).filter("pos <> rank").isEmpty() and rounds.double == 0


def test_dense_parts_over_the_bound_are_not_rewritten(spark, monkeypatch):
    """Where every part is large and has nothing to contract, edges are not joined with names of parts, nor with degrees; a self-loop alone is a small part."""
    ring = lambda at: [(at + k, at + (k + step) % 40) for k in range(40) for step in (1, 3, 7)]
    build = lambda pairs: Graph.from_dense_edges(spark, 100, spark.createDataFrame(pairs, "s bigint, t bigint"))
    g = build(ring(0) + ring(50))
    assert parted(g.edges, g.edge_count, 50).large.inputFiles() == g.edges.inputFiles()
    rounds, written = joins.Rounds(), []
    monkeypatch.setattr(joins, "Table", lambda df, *watch: written.append(df.columns) or Table(df, *watch))
    found = joins.components_by_joins(g.edges, rounds)
    assert sorted(map(tuple, found.collect())) == [(v, 0) for v in range(40)] + [(v, 50) for v in range(50, 90)]
    assert written.count(["a", "b"]) == 3 and rounds.contract == 1  # the edges, those inside a colour, and none left
    monkeypatch.undo()
    mixed = build(ring(0) + [(60, 61), (61, 60), (70, 70)])
    found = parted(mixed.edges, mixed.edge_count, 50)
    assert found.large.count() == found.named.count() == 120 and found.batches.count() == 3


def test_dense_graphs_over_the_bound_skip_the_search_for_parts(spark, monkeypatch):
    """Many edges a vertex: joins alone, and the same components, small parts and lone vertices included."""
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(900)] + [(60 + rng.randrange(20), 60 + rng.randrange(20)) for _ in range(500)] + [(41, 42), (42, 43), (43, 42), (42, 3), (50, 50)]
    g = Graph.from_dense_edges(spark, 82, spark.createDataFrame(pairs, "s bigint, t bigint"))
    want = sorted(map(tuple, scc.decompose(g, "local").membership.collect()))
    monkeypatch.setattr(scc, "parted", None)
    found = scc.decompose(g, part_edges=100)
    assert g.edge_count > 8 * 82 and sorted(map(tuple, found.membership.collect())) == want and found.rounds.total > 0


def forest(spark, cycle=False, seed=3):
    """A tree of 120 edges, one of 9, a pair and vertices without edges; with a cycle of three before a tail, if asked for."""
    rng = random.Random(seed)
    names = list(range(150))
    rng.shuffle(names)
    pairs = [(names[rng.randrange(max(0, k - 4), k)], names[k]) for k in range(1, 121)] + [(names[121 + (k - 1) // 2], names[121 + k]) for k in range(1, 10)] + [(names[132], names[131])]
    if cycle:
        pairs += [(names[140], names[141]), (names[141], names[142]), (names[142], names[140]), (names[142], names[143]), (names[143], names[144])]
    return Graph.from_dense_edges(spark, 150, spark.createDataFrame(pairs, "s bigint, t bigint"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_forest_over_the_bound_is_followed_once(spark, monkeypatch):
    """Trees are their own quotient: one evaluation, where parts were searched by rounds over all edges, twice, and chains contracted."""
    g = forest(spark)
    want = scc.decompose(g, "local")
    order = schedule(want.condensation, "local")
    found = scc.decompose(g, part_edges=200)
    assert found.condensation.rooted() is None and found.profile == want.profile  # one batch
    small = scc.decompose(g, part_edges=125)  # no tree is over the bound: peaks are known as before
    monkeypatch.setattr(parts, "connected_components", None)
    again = scc.decompose(g, part_edges=125)
    assert small.profile == again.profile == want.profile
    monkeypatch.setattr(scc, "components_by_joins", None)
    monkeypatch.setattr(scc, "parted", None)
    found = scc.decompose(g, part_edges=50)
    monkeypatch.setattr("arcwave.operators.schedule.parted", None)
    for d in (again, found):
        assert rows(d.membership) == rows(want.membership) and rows(d.components) == rows(want.components) and d.components.dtypes == want.components.dtypes
        assert rows(d.condensation.edges.select("src", "dst")) == rows(want.condensation.edges.select("src", "dst")) and d.profile.counts == want.profile.counts
        s = d.condensation.schedule()
        assert rows(s.table) == rows(order.table) and s.wave_count == order.wave_count
    assert not found.violations().filter("broken > 0").collect()
    assert replace(found.condensation, edges=found.condensation.edges.filter("src % 2 = 0")).rooted() is None  # depths are of other edges


def test_a_path_over_the_bound_has_its_ranks_for_an_order(spark, monkeypatch):
    names = list(range(400))
    random.Random(9).shuffle(names)
    g = Graph.from_dense_edges(spark, 400, spark.createDataFrame(list(zip(names, names[1:])), "s bigint, t bigint"))
    monkeypatch.setattr(scc, "parted", None)
    monkeypatch.setattr("arcwave.operators.schedule.global_rank", None)
    s = scc.decompose(g, part_edges=50).condensation.schedule()
    assert rows(s.table) == sorted((v, k, k, k) for k, v in enumerate(names))


def test_a_cycle_is_no_forest(spark):
    g = forest(spark, cycle=True)
    assert g.edge_count < g.vertex_count
    want, found = scc.decompose(g, "local"), scc.decompose(g, part_edges=50)
    assert found.condensation.rooted() is None and rows(found.membership) == rows(want.membership) and rows(found.components) == rows(want.components)


def test_a_band_reads_no_values_but_those_it_needs(spark, monkeypatch):
    """On a path a band needs one value; all values of all earlier bands were joined before."""
    n, made, read = 240, [], []

    def table(df, *more, **options):
        read.append([f for f in df.inputFiles() if any(p in f for p in made)])
        t = Table(df, *more, **options)
        if t.df.columns == ["component", "value"]:
            made.append(t.path)
        else:
            read.pop()
        return t

    monkeypatch.setattr(bands, "Table", table)
    monkeypatch.setattr(bands, "WINDOW", 8)
    c = Condensation(spark.range(n - 1).selectExpr("id src", "id + 1 dst"), n, n - 1)
    got, count = bands.evaluate(c, schedule(c), spark.range(n).selectExpr("id component", "id % 5 w"), lambda i, own, seen: own["w"] + max((v for _, v in seen), default=0), "bigint", 20)
    assert count == len(made) == 12 and rows(got) == [(k, sum(i % 5 for i in range(k + 1))) for k in range(n)]
    assert all(len({f.rsplit("/", 1)[0] for f in one}) <= 1 for one in read)


@pytest.mark.parametrize("window", [2, 100])
def test_values_reach_bands_far_behind(spark, monkeypatch, window):
    """Edges over many bands and waves dealt over tasks, whether values are read where they were written or are sent on."""
    rng = random.Random(6)
    monkeypatch.setattr(bands, "WINDOW", window)
    edges = {(k, k + 1) for k in range(60)} | {tuple(sorted(rng.sample(range(61), 2))) for _ in range(80)} | {(30, 61 + k) for k in range(25)} | {(61 + rng.randrange(25), 86 + rng.randrange(20)) for _ in range(40)} | {(0, 105)}
    c = Condensation(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"), 106, len(edges))
    s, weights = schedule(c), spark.range(106).selectExpr("id component", "id % 7 + 1 weight")

    def step(i, own, seen):
        assert [x for x, _ in seen] == sorted(a for a, b in edges if b == i)
        return own["weight"] + max((v for _, v in seen), default=0)

    got, count = bands.evaluate(c, s, weights, step, "bigint", 10)
    assert count > 6 and rows(got) == rows(longest_paths(c, s, weights))
    members, _ = bands.banded(s, 10)
    sizes = dict(rows(members.groupBy("rank").agg(F.countDistinct("band"))))
    assert set(sizes.values()) == {1} and members.filter("task > 0").count() > 0  # no wave is torn, and a wide one is dealt
