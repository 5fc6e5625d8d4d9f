"""A training-data pipeline over ``documents``: toxicity, near-copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before kept. The first four return the columns of
``documents``, whatever their names; the last returns where each remaining document is packed. In every stage rows with a
null id or text and rows without words are clean: they stay, also where they repeat, and are packed with one token. An
empty table, also of labels or benchmark items, gives an empty or unfiltered result and no error. Texts of any length are
judged whole. Rows that repeat an id and a text are toxic, leaking or redacted alike, and one of them stays as the copy of its group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm import decontamination, ngram_join, packing, secret_scan, toxicity
from arcwave.plans.lineage import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-gram Jaccard similarity of 0.75 or more, that of the smallest id."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=1)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars brought up to date."""
    clean = secret_scan.redact(docs, secret_scan.scan(docs, secret_scan.train(spark)))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in padded batches of bounded size."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_copy),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: A conditional random field and a forest can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
