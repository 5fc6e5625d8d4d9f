from arcwave.operators.scc import decompose
from arcwave.streaming.rebuild import maintain


def test_graph_follows_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    seen = []

    def handle(graph, number):
        seen.append((number, graph.vertex_count, graph.edge_count, decompose(graph).component_count))

    for pairs in ([(1, 2), (2, 3)], [(3, 1), (3, 1), (4, None)]):
        spark.createDataFrame(pairs, "a bigint, b bigint").coalesce(1).write.mode("append").parquet(source)
        query = maintain(spark.readStream.schema("a bigint, b bigint").parquet(source), str(tmp_path / "edges"), str(tmp_path / "state"), handle, once=True)
        query.awaitTermination(120)
    assert [s[1:] for s in seen] == [(3, 2, 3), (3, 3, 1)]
