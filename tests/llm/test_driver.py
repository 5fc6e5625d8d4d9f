"""What stays out of the driver."""

import numpy as np
from pyspark.sql import functions as F

from arcwave.llm import toxicity


def test_toxicity_trains_in_a_task(spark, monkeypatch):
    """The sample and what training makes of it used to be held by the driver's Python beside its JVM."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("you foul wretch number "), "id")).otherwise(F.concat(F.lit("a calm note number "), "id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    rows = docs.join(labels, "doc_id").filter(~toxicity.held_out("doc_id")).toArrow().sort_by("doc_id")
    toxic = np.array(rows["toxic"].to_pylist(), bool)
    want = toxicity.fit(rows["text"], toxic, np.ones(len(toxic)))

    def refused(*_):
        raise AssertionError("training on the driver")

    monkeypatch.setattr(toxicity, "fit", refused)  # workers import their own
    got = toxicity.train(docs, labels)
    assert got.keys() == want.keys() and len(want["keys"]) and (got["keys"] == want["keys"]).all()
    assert np.array_equal(got["weights"], want["weights"]) and np.allclose(got["text"], want["text"]) and got["transition"] == want["transition"]
