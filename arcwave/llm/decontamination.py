"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed hashes the words that a fixed mask keeps among ``SPAN`` consecutive ones and ignores the others, so a
substituted word spoils only the masks that look at it. Seeds of texts and benchmark items are joined;
each hit fixes an alignment (item, difference of places), and around it the words are compared place by
place: a match counts 1, a substitution costs ``COST``, and the best segment must reach
``min(MIN_SCORE, SHARE * words of the item)``, or, in items of ``ONE_OFF`` words or more, all words but one must match.

Where that bound is under ``SPAN`` words (items of up to 11), runs of just so many words are hashed too, and
items of ``ONE_OFF`` to 9 words once more without each of their inner words; so no alignment over the bound lacks a
seed. These seeds are made only for the lengths that the benchmark has.

Words are the lower-cased runs of letters and digits. A small bit table of the pairs (first word, last
word) that all masks keep is folded into the plan; it spares the texts' other places the masks. It only
skips places that cannot match, whatever the size of the benchmark. Items of fewer than ``min_words`` words
(``SPAN`` unless told otherwise; the queries take 1) are left out. Null and empty texts are clean, as are all texts where the benchmark
is empty; an empty table gives no rows. Rows that repeat an id and text get one answer; equal items of several ids are
all found, and of several alignments the best counts. Texts of any length are read whole, as one array of 8 bytes a word.
Columns of the input with names used here do not matter. The benchmark's seeds are broadcast up to ``BROADCAST_ROWS`` and joined by a shuffle beyond.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.textkit import row_name
from arcwave.plans.lineage import cut
from arcwave.plans.names import free

SPAN = 10
MASKS = ("1101100101", "1011010011", "1100111001")
COST = 2
MIN_SCORE = 12
SHARE = 0.8
ONE_OFF = 5
BROADCAST_ROWS = 500_000
TABLE_BITS = 18


def word_codes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _places(codes: Column, size: int = SPAN) -> Column:
    """1-based first places of all spans."""
    none = F.array().cast("array<int>")
    return F.when(F.size(codes) >= size, F.sequence(F.lit(1), F.size(codes) - size + 1)).otherwise(none)


def _ends(codes: Column, at: Column, size: int = SPAN) -> Column:
    return F.xxhash64(F.lit(size), F.get(codes, at - 1), F.get(codes, at + size - 2))


def _seeds(codes: Column, at: Column) -> Column:
    """The hash of each mask over the span at a place; a mask's number keeps its hashes apart from the others'."""
    return F.array(*[F.xxhash64(F.lit(k), *[F.get(codes, at + j - 1) for j, bit in enumerate(mask) if bit == "1"]) for k, mask in enumerate(MASKS)])


def _least(n: int) -> int:
    """The score that an item of n words needs."""
    return min(MIN_SCORE, math.ceil(SHARE * n))


def _run_seed(codes: Column, at: Column, size: int) -> Column:
    return F.array(F.xxhash64(F.lit(-size), *[F.get(codes, at + j - 1) for j in range(size)]))


def _gap_seeds(codes: Column, at: Column, size: int) -> Column:
    """The hashes of a run without each of its inner words."""
    return F.array(*[F.xxhash64(F.lit(size * SPAN + gap), *[F.get(codes, at + j - 1) for j in range(size) if j != gap]) for gap in range(1, size - 1)])


def _short_lengths(items: DataFrame) -> tuple[dict[int, list[int]], list[int]]:
    """By the length of a run that is under ``SPAN``, the items' lengths that need it; and the lengths that take gaps."""
    lengths = items.select(F.size("codes").alias("n")).filter(F.col("n") <= SPAN * 2).distinct().collect()  # at most 2 * SPAN rows
    runs: dict[int, list[int]] = {}
    for n in sorted(r["n"] for r in lengths):
        if 0 < _least(n) < SPAN:
            runs.setdefault(_least(n), []).append(n)
    return runs, sorted(r["n"] for r in lengths if ONE_OFF <= r["n"] < SPAN)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_name(id_col, text_col).alias("key"))


def _end_table(items: DataFrame, runs: dict[int, list[int]], gaps: list[int], bits: int = TABLE_BITS) -> Column:
    """A bit table of the items' end pairs as a constant array of words; its size is fixed by ``bits``."""
    codes, none = F.col("codes"), F.array().cast("array<bigint>")
    pairs = lambda size: F.transform(_places(codes, size), lambda i: _ends(codes, i, size))
    short = [F.when(F.size(codes).isin(lengths), pairs(size)).otherwise(none) for size, lengths in runs.items()]
    short += [F.when(F.size(codes) == size, pairs(size)).otherwise(none) for size in gaps]
    ends = items.select(F.explode(F.concat(pairs(SPAN), *short)).alias("h"))
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    words = ends.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))).alias("v"))
    table = ["0"] * (1 << bits - 6)
    for row in words.collect():  # at most 2 ** (bits - 6) rows
        table[row["w"]] = str(row["v"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, shift): distinct alignments with a seed hit; word place in the text = place in the item + shift."""
    runs, gaps = _short_lengths(items)
    table = _end_table(items, runs, gaps)
    codes = F.col("codes")
    bit = lambda h: F.call_function("shiftright", F.get(table, F.shiftright(h.bitwiseAND((1 << TABLE_BITS) - 1), 6).cast("int")), h.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    kinds = [(SPAN, _seeds, None)] + [(size, lambda c, i, size=size: _run_seed(c, i, size), lengths) for size, lengths in runs.items()]
    kinds += [(size, lambda c, i, size=size: _gap_seeds(c, i, size), [size]) for size in gaps]
    at = docs.select("key", word_codes(F.col("text")).alias("codes"))
    for k, (size, _, _) in enumerate(kinds):
        at = at.withColumn(f"at{k}", F.filter(_places(codes, size), lambda i: bit(_ends(codes, i, size))))
    # explode_outer: explode would make Catalyst infer a filter and push a copy of these expressions, word splitting and all, below it
    seeded = lambda places, seeds, name: F.transform(places, lambda i: F.struct(i.alias(name), seeds(codes, i).alias("h")))
    hits = [seeded(F.col(f"at{k}"), seeds, "i") for k, (_, seeds, _) in enumerate(kinds)]
    found = at.select("key", F.explode_outer(F.concat(*hits)).alias("x")).select("key", "x.i", F.explode_outer("x.h").alias("h"))
    none = F.array().cast("array<struct<j:int,h:array<bigint>>>")
    own = [seeded(_places(codes, size), seeds, "j") for size, seeds, _ in kinds]
    own = [x if lengths is None else F.when(F.size(codes).isin(lengths), x).otherwise(none) for x, (_, _, lengths) in zip(own, kinds, strict=True)]
    seeds = items.select("item", F.explode(F.concat(*own)).alias("x")).select("item", "x.j", F.explode("x.h").alias("h"))
    seeds = cut(seeds)
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    return found.join(seeds, "h").select("key", "item", (F.col("i") - F.col("j")).alias("shift")).distinct()


def _same(text: Column, item: Column, shift: Column, j: Column) -> Column:
    return (j + shift >= 1) & (F.get(text, j + shift - 1) == F.get(item, j - 1))


def matches(text: Column, item: Column, shift: Column) -> Column:
    """How many of the item's words stand in their places."""
    return F.aggregate(F.sequence(F.lit(1), F.size(item)), F.lit(0), lambda acc, j: acc + F.when(_same(text, item, shift, j), 1).otherwise(0))


def best_segment(text: Column, item: Column, shift: Column) -> Column:
    """The best score of a run of places, with matches 1 and substitutions -COST; places outside the text count as substitutions."""
    same = lambda j: F.when(_same(text, item, shift, j), 1).otherwise(-COST)
    step = lambda acc, j: F.struct(F.greatest(acc["run"] + same(j), F.lit(0)).alias("run"), F.greatest(acc["best"], acc["run"] + same(j)).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.size(item)), F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = SPAN) -> DataFrame:
    """(key, item, score): the benchmark items that each text holds, by their best alignment; key = 128 bits of a digest of id and text."""
    rows = _keyed(docs, id_col, text_col)
    items = cut(benchmark.select(F.col(item_col).alias("item"), word_codes(F.col(item_text)).alias("codes")).filter(F.size("codes") >= max(min_words, 1)))
    found = cut(alignments(rows, items))
    hit = cut(found.select("key").distinct())
    small = hit.count() <= BROADCAST_ROWS
    held = rows.join(F.broadcast(hit) if small else hit, "key", "left_semi").select("key", word_codes(F.col("text")).alias("words")).dropDuplicates(["key"])
    pairs = found.join(items, "item").join(held, "key")
    scored = pairs.select("key", "item", F.size("codes").alias("n"), *[f(F.col("words"), F.col("codes"), F.col("shift")).alias(c) for f, c in ((best_segment, "score"), (matches, "same"))])
    enough = (F.col("score") >= F.least(F.lit(MIN_SCORE), F.ceil(F.col("n") * SHARE))) | (F.col("n") >= ONE_OFF) & (F.col("same") >= F.col("n") - 1)
    return scored.filter(enough).groupBy("key", "item").agg(F.max("score").alias("score"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = SPAN) -> DataFrame:
    """(id, key, contaminated, n_items, items, best_score) for every row; items is an ascending array of ids."""
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text, min_words)
    by_text = found.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("score").cast("bigint").alias("best_score"))
    rows = _keyed(docs, id_col, text_col).select("id", "key").join(by_text, "key", "left")
    items = F.coalesce("items", F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>"))
    return rows.select(F.col("id").alias(id_col), "key", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), F.coalesce("best_score", F.lit(0).cast("bigint")).alias("best_score"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = SPAN) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    key = free(docs, "key")
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text, min_words).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_name(id_col, text_col)).join(found, key, "left_anti").select(docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=1)
    return found.select("doc_id", "contaminated", "n_items", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "best_score")
