"""Graphs over whole tables, depth-first queries in SQL, layers, and snapshots that stay chunks."""

import pytest
from pyspark.sql import functions as F

from arcwave import errors as E
from arcwave.graph import Graph
from arcwave.operators.scc import decompose
from arcwave.operators.traversal import breadth_first
from arcwave.plans.lineage import Layers
from arcwave.sources import snapshot as S
from arcwave.sources import tables
from test_queries import test_query_matches_sql as matches_sql

PROFILE = bytes(range(32))


def drawn(spark, n, m, seed):
    import random

    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return Graph.from_dense_edges(spark, n, spark.createDataFrame(pairs, "a bigint, b bigint")), set(pairs)


@pytest.mark.parametrize("name", ["dfs_preorder", "dfs_forest", "canonical_edges_handoff_whole", "scc_components_cosupp_whole", "condensation_successors", "import_parts", "snapshot_chunks_decoded"])
def test_matches_sql(spark, sf_dir, name):
    matches_sql(spark, sf_dir, name)


def test_whole_graphs_read_every_row(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    followed = lines.count() - lines.select("l_orderkey").distinct().count()
    for build in (tables.copart_whole, tables.cosupp_whole):
        assert build(spark, sf_dir)[1].count() == followed
    assert tables.handoff_whole(spark, sf_dir)[1].count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count() - 1


def test_layers_keep_every_row(spark):
    layers, most = Layers(), 0
    for k in range(9):
        newest = layers.add(spark.range(1).select((F.col("id") + k).alias("id")))
        assert newest.df.first()["id"] == k
        most = max(most, len(layers.frames))
    assert sorted(r["id"] for r in layers.df.collect()) == list(range(9)) and most <= 5


def test_long_walk_by_joins(spark):
    g = tables.chain(spark, 12)
    assert [r["dense"] for r in breadth_first(g, 0, strategy="distributed").orderBy("pos").collect()] == list(range(12))
    order = breadth_first(drawn(spark, 40, 90, 3)[0], 0)
    again = breadth_first(drawn(spark, 40, 90, 3)[0], 0, strategy="distributed")
    assert order.exceptAll(again).isEmpty() and again.exceptAll(order).isEmpty()


@pytest.mark.parametrize("words", [1, 3, 7, 1000])
def test_chunks_round_trip(spark, words):
    g, pairs = drawn(spark, 9, 20, words)
    back = S.decode_chunks(S.snapshot_chunks(g, PROFILE, words), PROFILE)
    assert {tuple(r) for r in back.edges.collect()} == pairs and back.vertex_count == 9 and not back.has_reverse
    assert decompose(back).membership.exceptAll(decompose(g).membership).isEmpty()


def test_chunks_pass_the_gates(spark):
    chunks = S.snapshot_chunks(drawn(spark, 4, 6, 1)[0], PROFILE, 2)
    for bad, limits, kind in [
        (chunks.limit(0), None, "HeaderTruncated"),
        (chunks.filter("chunk <> 2"), None, "Truncated"),
        (chunks.unionByName(chunks.filter("chunk = 1").withColumn("chunk", F.lit(99).cast("bigint"))), None, "Trailing"),
        (chunks, S.SnapshotLimits(max_vertices=3), "VertexLimit"),
        (chunks, S.SnapshotLimits(max_bytes=80), "ByteLimit"),
    ]:
        with pytest.raises(E.SnapshotError) as found:
            S.decode_chunks(bad, PROFILE, limits)
        assert found.value == E.SnapshotError(kind)
    with pytest.raises(E.SnapshotError, match="Profile"):
        S.decode_chunks(chunks, bytes(32))
