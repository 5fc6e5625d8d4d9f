"""User functions over bands of waves, colour refinement, table functions in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from arcwave.functions import tables as table_functions
from arcwave.graph import Graph
from arcwave.operators import bands, colours
from arcwave.operators.condensation import Condensation
from arcwave.operators.scc import decompose
from arcwave.operators.schedule import longest_paths, schedule
from test_queries import test_query_matches_sql as matches_sql


@pytest.mark.parametrize("name", ["sql_ranks", "scc_merged_report", "components_renamed"])
def test_matches_sql(spark, sf_dir, name):
    matches_sql(spark, sf_dir, name)


def test_a_thousand_waves_are_few_jobs(spark):
    n = 1000
    c = Condensation(spark.range(n - 1).selectExpr("id src", "id + 1 dst"), n, n - 1)
    s = schedule(c)
    payload = spark.range(n).selectExpr("id component", "id % 3 w", "'x' component_name")
    got, jobs = bands.evaluate(c, s, payload, lambda i, own, seen: own["w"] + sum(v for _, v in seen), "bigint", band=300)
    total, want = 0, []
    for k in range(n):
        total += k % 3
        want.append((k, total))
    assert jobs == 4 and sorted(map(tuple, got.collect())) == want


def test_wide_waves_are_dealt_over_tasks(spark):
    """60 sources and 60 targets over a bound of 10 a band, beside a narrow tail."""
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(60), 60 + rng.randrange(60)) for _ in range(150)} | {(60 + k, 120) for k in range(60)} | {(120, 121), (121, 122)})
    c = Condensation(spark.createDataFrame(pairs, "src bigint, dst bigint"), 123, len(pairs))
    s = schedule(c)
    members, count = bands.banded(s, 10)
    tasks = {(r["band"], r["task"]) for r in members.collect()}
    assert count >= 3 and len(tasks) > 8
    weights = spark.range(123).selectExpr("id component", "id % 5 + 1 weight")
    want = longest_paths(c, s, weights)
    calls = spark.sparkContext.accumulator(0)

    def step(i, own, seen):
        assert [x for x, _ in seen] == sorted(x for x, _ in seen) and all(v is not None for _, v in seen)
        calls.add(1)
        return own["weight"] + max((v for _, v in seen), default=0)

    got, _ = bands.evaluate(c, s, weights, step, "bigint", 10)
    assert got.exceptAll(want).isEmpty() and got.count() == 123 and calls.value == 123


def test_bands_of_nothing_and_without_payload(spark):
    none = Condensation(spark.createDataFrame([], "src bigint, dst bigint"), 0, 0)
    payload = spark.createDataFrame([], "component bigint, w bigint")
    assert bands.evaluate(none, schedule(none), payload, lambda i, own, seen: 0, "bigint")[0].collect() == []
    two = Condensation(spark.createDataFrame([(1, 0)], "src bigint, dst bigint"), 2, 1)
    got, _ = bands.evaluate(two, schedule(two), payload.select("component"), lambda i, own, seen: f"{i}:{own}:{seen}", "string")
    assert sorted(map(tuple, got.collect())) == [(0, "0:None:[(1, '1:None:[]')]"), (1, "1:None:[]")]


def test_colours_know_no_names(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(20), rng.randrange(20)) for _ in range(40)]
    names = list(range(20))
    rng.shuffle(names)
    build = lambda x: Graph.from_dense_edges(spark, 20, spark.createDataFrame(x, "a bigint, b bigint"))
    table = lambda g: sorted(map(tuple, colours.histogram(g).collect()))
    g, h = build(pairs), build([(names[a], names[b]) for a, b in pairs])
    assert table(g) == table(h)
    assert table(g) != table(build([*pairs[1:], ((pairs[0][0] + 1) % 20, pairs[0][1])]))
    d, r = decompose(g), decompose(h)
    both = colours.induced(d, r, spark.createDataFrame(list(enumerate(names)), "stable bigint, name bigint"))
    assert both.count() == d.component_count == r.component_count == both.select("renamed").distinct().count()
    assert both.join(d.components, "component").filter("n <> member_count").isEmpty()


def test_table_functions(spark):
    table_functions.register(spark)
    rows = [(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "b", "c"), (2, "a", None), (2, "z", "z"), (None, "p", "q"), (3, None, None)]
    spark.createDataFrame(rows, "part int, src string, dst string").createOrReplaceTempView("pairs_of_parts")
    got = spark.sql("SELECT * FROM graph_components(TABLE(pairs_of_parts) PARTITION BY part)").collect()
    assert sorted(map(tuple, got)) == [("1", "a", "a", True), ("1", "b", "a", True), ("1", "c", "c", False), ("2", "a", "a", False), ("2", "z", "z", True), ("None", "p", "p", False), ("None", "q", "q", False)]
    ranks = spark.sql("SELECT * FROM graph_ranks(TABLE(SELECT * FROM pairs_of_parts WHERE part IS NULL OR part = 1) PARTITION BY part)").collect()
    assert sorted(map(str, ranks)) == sorted(map(str, [*ranks[:0], *spark.createDataFrame([("1", "a", None), ("1", "b", None), ("1", "c", None), ("None", "p", 0), ("None", "q", 1)], "part string, vertex string, rank bigint").collect()]))
    assert spark.sql("SELECT * FROM graph_components(TABLE(SELECT * FROM pairs_of_parts WHERE false) PARTITION BY part)").filter(F.col("vertex").isNotNull()).isEmpty()
