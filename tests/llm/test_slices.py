"""What a task makes of a batch follows a slice of it."""

import pyarrow as pa

import corpus_pipeline
from arcwave.llm import ngram_join, secret_scan, toxicity
from arcwave.llm.textkit import slices
from arcwave.plans.lineage import cut


def test_slices_hold_every_row_once():
    texts = [None, "", "x" * 50, "é" * 400, "y", None, *["z" * 30] * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    parts = list(slices(iter([batch, batch.slice(2, 9), batch.slice(0, 0)]), 1, limit=100, rows=4))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch, batch.slice(2, 9)])
    assert all(p.num_rows == 1 or (p.num_rows <= 4 and sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 100) for p in parts)
    assert len(list(slices(iter([batch]), 1))) == 1


def test_stages_give_small_batches(spark, sf_dir, monkeypatch):
    """10,000 rows of some KB in one batch: each stage gives batches of a few MB at most; they were as large as the input and more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    forest = secret_scan.train(spark)
    found = cut(secret_scan.scan(docs, forest))
    steps = []
    kind = type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: steps.append((self.schema.names, f)) or real(self, f, schema))
    toxicity.score(docs, model)
    ngram_join.sketches(docs, 5, "doc_id", "text")
    secret_scan.scan(docs, forest)
    secret_scan.redact(docs, found)
    assert len(steps) == 4
    words = ["alpha", "beta", "gamma", "delta", "password = 'x8Kq2!vLp09z'", "omega", "kappa"]
    rows = [" ".join(f"{words[(k * j) % 7]}{k % 91}" for j in range(1, 60)) for k in range(10_000)]
    held = {"doc_id": pa.array(range(10_000)), "id": pa.array(range(10_000)), "text": pa.array(rows), "source": pa.array(["web"] * 10_000), "path": pa.array(["web"] * 10_000)}
    for names, run in steps:
        spans = pa.array([[{"start": 0, "end": 3}]] * 10_000, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        batch = pa.RecordBatch.from_arrays([held.get(n, pa.array(range(10_000)) if n == "key" else spans) for n in names], names)
        sizes = [(b.num_rows, b.nbytes) for b in run(iter([batch]))]
        assert max(size for _, size in sizes) < 5 << 20, names
