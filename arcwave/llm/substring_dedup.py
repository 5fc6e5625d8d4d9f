"""Substring dedup by sliding sentence spans.

A text is cut into sentences in two ways. The cuts by words alone stand after a word that ends in ``.``,
``!`` or ``?``. The cuts by layout stand also after a line feed and before a capitalised word (joined
passages often lack the stop). In both, a sentence of over ``MAX_WORDS`` words is cut where the hash of
the two lower-cased words beside a place is the least of ``MAX_WORDS`` places in turn, so every cut depends on
the words around it, not on where its sentence began, and none is further than ``MAX_WORDS`` from the next.

A span runs over the fewest consecutive sentences, at least two, that hold ``MIN_WORDS`` words, one
forward from each cut and one back from each cut. All sentences of a repeated run of at least that size are covered
by them. Two copies of a passage share all cuts by words that are ``MAX_WORDS`` words inside it, so
a passage of ``4 * MAX_WORDS + MIN_WORDS - 2`` words (50) always shares a span, whatever its case, layout and surroundings.

Spans are hashed over their lower-cased words and joined globally; the first occurrence, by (doc_id, row
key, place), stays, and every sentence that another occurrence covers is removed, in other documents or in
the same one. Sentences are counted between the cuts of both kinds.

Null texts count as empty; empty texts have no sentences and come back unchanged, as do texts with no repeat; an empty table
gives no rows. Rows that repeat an id and text are one document and get one answer; rows with one id and other texts are apart.
Null ids come first. Texts of any length are cut whole. Input columns other than the id and the text are not read.
Spans are named by 96 bits of two hashes, and counted by them with map-side combination first; only those that occur twice carry
their places on, and a span that many rows hold is dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.textkit import BASE, STEP, U64, mix, text_chunks, word_hashes
from arcwave.plans.lineage import cut
from arcwave.plans.spread import small, spread_join

MIN_SENTENCES = 2
MIN_WORDS = 20
MAX_WORDS = 8
_RUN_BITS = 24
_NAME = ["h", "g"]

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def _cut_long(words: np.ndarray, begins: np.ndarray, max_words: int) -> np.ndarray:
    """``begins`` and the cuts inside long sentences: of every ``max_words`` places in turn, the last of the least hash."""
    n = len(words) - max_words + 1
    if n < 1:
        return begins
    beside = np.zeros(len(words), np.uint64)
    beside[1:] = mix(words[:-1] * BASE + words[1:] * STEP)
    least, at = beside[:n].copy(), np.arange(n)
    for k in range(1, max_words):
        less = beside[k : k + n] <= least
        np.copyto(least, beside[k : k + n], where=less)
        np.copyto(at, np.arange(k, k + n), where=less)
    seen = np.concatenate([[0], np.cumsum(begins)])
    found = begins.copy()
    found[at[seen[max_words:] == seen[:n]]] = True
    return found


def sentences(buf: np.ndarray, off: np.ndarray, max_words: int = MAX_WORDS) -> tuple[np.ndarray, ...]:
    """Word hashes, byte starts, each text's first word, and the first words of the sentences by words and by layout."""
    words, starts, ends, first = word_hashes(buf, off)
    n = len(words)
    if not n:
        none = np.zeros(0, np.int64)
        return words, starts, first, none, none
    begins = np.zeros(n, bool)
    begins[1:] = _STOP[buf[ends[:-1] - 1]]
    begins[first[:-1][np.diff(first) > 0]] = True
    feeds = np.concatenate([[0], np.cumsum(buf == 10)])
    lead, second = buf[starts], buf[np.minimum(starts + 1, len(buf) - 1)]
    layout = begins | (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    layout[1:] |= feeds[starts[1:]] > feeds[ends[:-1]]
    return words, starts, first, np.flatnonzero(_cut_long(words, begins, max_words)), np.flatnonzero(_cut_long(words, layout, max_words))


def _least_runs(begin: np.ndarray, first: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the shortest spans forward from each sentence's start and back from each sentence's end."""
    bounds, heads = np.append(begin, first[-1]), np.searchsorted(begin, first)
    at = np.arange(len(begin))
    text = np.repeat(np.arange(len(first) - 1), np.diff(heads))
    stop = np.maximum(np.searchsorted(bounds, begin + min_words), at + min_sentences)
    good = stop <= heads[1:][text]
    back = np.minimum(np.searchsorted(bounds, bounds[1:] - min_words, side="right") - 1, at + 1 - min_sentences)
    fits = back >= heads[:-1][text]
    return np.concatenate([begin[good], bounds[back[fits]]]), np.concatenate([bounds[stop[good]], bounds[1:][fits]])


def spans(buf: np.ndarray, off: np.ndarray, min_sentences: int, min_words: int, max_words: int) -> tuple[np.ndarray, ...]:
    """Hash, text row, word place inside the text, number of words, and second hash of every span."""
    words, _, first, *cuts = sentences(buf, off, max_words)
    if not len(words):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.int32)
    begin, end_word = (np.concatenate(x) for x in zip(*[_least_runs(c, first, min_sentences, min_words) for c in cuts], strict=True))
    runs = np.unique(begin << _RUN_BITS | end_word - begin)
    begin, size = runs >> _RUN_BITS, runs & (1 << _RUN_BITS) - 1
    end_word = begin + size
    row = np.searchsorted(first, begin, side="right") - 1
    power = np.ones(len(words) + 1, np.uint64)
    power[1:] = BASE
    power = np.multiply.accumulate(power)
    inverse = np.ones(len(words) + 1, np.uint64)
    inverse[1:] = _INVERSE
    inverse = np.multiply.accumulate(inverse)
    names = []
    for value in (words, mix(words ^ STEP)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:-1])])
        names.append(mix((sums[end_word] - sums[begin]) * inverse[begin] + size.astype(np.uint64)))
    return names[0], row, begin - first[row], size, (names[1] >> U64(32)).astype(np.uint32).view(np.int32)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text"))


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """(key bigint, runs array<bigint>): for each row key with a non-first repeated span, its spans as first word << 24 | words."""
    kind = docs.schema[id_col].dataType.simpleString()
    if not (min_sentences >= 1 and min_words >= 1 and max_words >= 1 and min_words + (min_sentences + 1) * max_words < 1 << _RUN_BITS):
        raise ValueError(f"spans have from 1 sentence and 1 word to 2 ** {_RUN_BITS} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, buf, off in text_chunks(b.column(1)):
                h, row, place, size, g = spans(buf, off, min_sentences, min_words, max_words)
                rows = pa.array(row + start)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g), b.column(0).take(rows), b.column(2).take(rows), pa.array(place << _RUN_BITS | size)], [*_NAME, "id", "key", "run"])

    rows = _keyed(docs, id_col, text_col)
    found = rows.mapInArrow(run, f"h bigint, g int, id {kind}, key bigint, run bigint")
    repeated = cut(found.groupBy(*_NAME).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hits = cut(spread_join(found, small(repeated.select(*_NAME)), _NAME, "key", counts=repeated))
    first = hits.groupBy(*_NAME).agg(F.min(F.struct("id", "key", "run")).alias("first")).select(*_NAME, F.col("first.key").alias("k0"), F.col("first.run").alias("r0"))
    other = spread_join(hits, small(cut(first)), _NAME, "key", counts=repeated).filter("key <> k0 or run <> r0")
    return other.groupBy("key").agg(F.collect_set("run").alias("runs"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """(id, text, n_sentences, n_removed, removed) for every row; removed lists start:end byte offsets of what went, comma-joined."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _keyed(docs, id_col, text_col).join(repeated_sentences(docs, id_col, text_col, min_sentences, min_words, max_words), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, gone, lists = [], [], [], []
            for start, _, buf, off in text_chunks(b.column(1)):
                _, starts, first, by_words, by_layout = sentences(buf, off, max_words)
                begin = np.union1d(by_words, by_layout)
                heads = np.searchsorted(begin, first)
                for i in range(len(off) - 1):
                    whole, own = buf[off[i] : off[i + 1]], begin[heads[i] : heads[i + 1]]
                    runs = b.column(2)[start + i].as_py()
                    counts.append(len(own))
                    if not runs:
                        texts.append(b.column(1)[start + i].as_py())
                        gone.append(0)
                        lists.append("")
                        continue
                    bounds = np.append(starts[own] - off[i], len(whole))
                    cover = np.zeros(len(own) + 1, np.int64)
                    runs = np.array(runs, np.int64)
                    at, size = (runs >> _RUN_BITS) + first[i], runs & (1 << _RUN_BITS) - 1
                    np.add.at(cover, np.searchsorted(own, at), 1)
                    np.add.at(cover, np.searchsorted(own, at + size), -1)
                    drop = np.cumsum(cover[:-1]) > 0
                    edge = np.diff(np.concatenate([[0], drop.astype(np.int8), [0]]))
                    pairs = list(zip(bounds[np.flatnonzero(edge == 1)].tolist(), bounds[np.flatnonzero(edge == -1)].tolist(), strict=True))
                    at, kept = 0, []
                    for s, e in pairs:
                        kept.append(whole[at:s].tobytes())
                        at = e
                    kept.append(whole[at:].tobytes())
                    texts.append(b"".join(kept).decode("utf-8", "replace"))
                    gone.append(int(drop.sum()))
                    lists.append(",".join(f"{s}:{e}" for s, e in pairs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(lists, pa.string())], ["id", "text", "n_sentences", "n_removed", "removed"])

    return rows.select("id", "text", "runs").mapInArrow(run, f"id {kind}, text string, n_sentences bigint, n_removed bigint, removed string").withColumnsRenamed({"id": id_col, "text": text_col})


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
