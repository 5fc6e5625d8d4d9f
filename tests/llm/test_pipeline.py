"""The pipeline's stages on the smallest tables, and its last stage against what the others kept."""

import corpus_pipeline
import __spark_entry__ as entry

from arcwave.llm import decontamination, ngram_join
from arcwave.plans.lineage import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "ngram_join":
            found = ngram_join.similar_components(docs)
            assert found.filter("n_shingles > 0").groupBy("component_id").count().filter("count > 1").isEmpty()
        if name == "decontamination":
            assert decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").isEmpty()
        if name == "packing":
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert counts[3] == counts[4] == counts[5] and counts == sorted(counts, reverse=True)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")].__len__() == 10
