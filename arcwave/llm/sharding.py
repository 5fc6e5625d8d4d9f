"""Sharding by balanced label propagation, under the law ``rows``: shard sizes are at most one row apart.

Equal texts are one group; groups are linked if they share one of their ``TOKENS`` smallest 5-gram
hashes. Labels start by each group's home: the hash that most groups share with it, lines shared by over 1 in ``8 * shards`` rows
aside. In each round half of the groups may ask to move to the label
where most of their linked rows are. Requests between two labels are met from the largest gain down, as far
as the other direction or the free room (``SLACK`` over an even share) pays for them; gains are counted in
classes, so a round's plan is a table of labels x labels x classes whatever the corpus. A request in the last
class that fits in part is met for a share of it, by hash.

At last rows stand in one global order (label, home, group, id) that is cut into equal runs. So
the law holds exactly, what shares a home stays together, and only groups at a cut, or larger than a shard, are split.

Null texts have size 1 and are equal to empty texts; texts without words have no links. Rows with equal ids are interchangeable where
their texts are equal; ties between shards go to the group's own, then to the smallest. An empty table gives no rows. Texts of any length
are read whole, 1 MB or one longer text at a time. Input columns of any other name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.ngram_join import text_sets
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import Table, cut
from arcwave.plans.spread import spread_join

SHARDS = 8
TOKENS = 4
ROUNDS = 4
SLACK = 0.05
CLASSES = 32


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS) -> DataFrame:
    """(id, size, text_crc32, g, toks): the group key, and the smallest 5-gram hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text", "text_crc32").alias("g"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [s[:tokens].view(np.int64) for s in text_sets(b.column(4))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in toks])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *toks])))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], ["id", "size", "text_crc32", "g", "toks"])

    return rows.mapInArrow(run, f"id {kind}, size bigint, text_crc32 bigint, g bigint, toks array<bigint>")


def _requests(edges: DataFrame, labels: DataFrame, shards: int, turn: int) -> DataFrame:
    """(g, w, label, best, gain) of the groups that would gain by a move this turn."""
    votes = edges.join(labels.select("g", "label"), "g").groupBy("tok").agg(*[F.sum(F.when(F.col("label") == k, F.col("w")).otherwise(0)).alias(f"v{k}") for k in range(shards)])
    heard = edges.join(votes, "tok").groupBy("g").agg(F.count(F.lit(1)).alias("links"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(shards)])
    own = lambda k: F.when(F.col("label") == k, F.col("w") * F.col("links")).otherwise(0)
    choice = F.array_max(F.array(*[F.struct((F.col(f"v{k}") - own(k)).alias("v"), (F.col("label") == k).cast("int").alias("stay"), F.lit(-k).alias("k")) for k in range(shards)]))
    now: Column = F.coalesce(*[F.when(F.col("label") == k, F.col(f"v{k}") - own(k)) for k in range(shards)])
    asked = heard.join(labels, "g").withColumn("choice", choice).withColumn("now", now)
    mine = F.pmod(F.xxhash64(F.col("g"), F.lit(turn)), F.lit(2)) == 0
    return asked.select("g", "w", "label", (-F.col("choice.k")).alias("best"), (F.col("choice.v") - F.col("now")).alias("gain")).filter((F.col("gain") > 0) & mine)


def _quotas(table: list, sizes: dict[int, int], room: float) -> dict[tuple[int, int], list[tuple[int, float]]]:
    """For each (from, to): the classes of gain that move, and what share of each."""
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in table:
        asked.setdefault((r["label"], r["best"]), []).append((r["class"], r["w"]))
    total = {p: sum(w for _, w in x) for p, x in asked.items()}
    free = {k: max(0.0, room - n) for k, n in sizes.items()}
    plan = {}
    for (a, b), x in sorted(asked.items()):
        left = min(total[a, b], total.get((b, a), 0))
        extra = min(total[a, b] - left, free.get(b, room))
        free[b] = free.get(b, room) - extra
        left += extra
        moves = []
        for c, w in sorted(x, reverse=True):
            share = min(1.0, left / w) if w else 0.0
            if share <= 0:
                break
            moves.append((c, share))
            left -= w * share
        plan[a, b] = moves
    return plan


def propagate(groups: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(g, w, t1, label) from (g, w, toks); t1 is the home."""
    posted = groups.select("g", "w", F.explode("toks").alias("tok"))
    shared = cut(posted.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("rows")).filter("n > 1"))
    edges = cut(spread_join(posted, shared, ["tok"], "g", counts=shared))
    total = groups.agg(F.sum("w")).first()[0] or 0
    home = edges.filter(F.col("rows") * 8 * shards <= total).groupBy("g").agg(F.max(F.struct("n", "tok")).alias("home")).select("g", F.col("home.tok").alias("t1"))
    edges = edges.select("g", "w", "tok")
    placed = groups.join(home, "g", "left").select("g", "w", F.coalesce("t1", F.get("toks", F.lit(0)), F.col("g")).alias("t1"))
    # the smallest hash is near 0 in a long text, so its rank among all hashes says nothing: mix it again
    start = F.pmod(F.shiftright(F.xxhash64("t1"), 8), F.lit(shards)).cast("int")
    now = Table(placed.select("g", "w", "t1", start.alias("label")))
    for turn in range(rounds):
        asked = Table(_requests(edges, now.df, shards, turn).withColumn("class", F.least(F.floor(F.log2(F.col("gain") + 1) * 2), F.lit(CLASSES - 1)).cast("int")))
        # at most shards * shards * CLASSES rows
        table = asked.df.groupBy("label", "best", "class").agg(F.sum("w").alias("w")).collect()
        if not table:
            break
        sizes = {r["label"]: r["w"] for r in now.df.groupBy("label").agg(F.sum("w").alias("w")).collect()}
        plan = _quotas(table, sizes, total / shards * (1 + SLACK))
        rows = [(a, b, c, s) for (a, b), x in plan.items() for c, s in x]
        if not rows:
            break
        allowed = F.broadcast(edges.sparkSession.createDataFrame(rows, "label int, best int, class int, share double"))
        draw = F.pmod(F.xxhash64(F.col("g"), F.lit(turn), F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
        moved = asked.df.join(allowed, ["label", "best", "class"]).filter(draw < F.col("share")).select("g", F.col("best").alias("to"))
        new = Table(now.df.join(moved, "g", "left").select("g", "w", "t1", F.coalesce("to", "label").alias("label")))
        now.drop()
        asked.drop()
        now = new
    return now.df


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard int, slot bigint) for every row; slots run from 0 in each shard."""
    rows = cut(described(docs, id_col, text_col))
    toks = [F.min(F.get("toks", F.lit(k))).alias(f"t{k}") for k in range(TOKENS)]
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("w"), *toks).select("g", "w", F.array_compact(F.array(*[f"t{k}" for k in range(TOKENS)])).alias("toks"))
    labels = propagate(cut(groups), shards, rounds)
    placed = rows.select("id", "size", "text_crc32", "g").join(labels.select("g", "t1", "label"), "g")
    placed = global_rank(placed, [F.col("label"), F.col("t1"), F.col("g"), F.col("id")], "rank")
    n = rows.count()
    placed = placed.withColumn("shard", F.expr(f"cast(rank * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("rank") - first).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
