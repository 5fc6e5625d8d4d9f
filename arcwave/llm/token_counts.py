"""Token counts without tokens: Viterbi over an Aho-Corasick automaton of a unigram vocabulary.

The automaton enumerates all vocabulary pieces that end at each character; dynamic programming
keeps, for each end, the best score and the number of pieces of the path that has it. Ties go as
in the exact tokenizer (a unigram model behind a Metaspace pre-tokenizer): a later path replaces
an earlier one only if its score is strictly larger, and paths into one end are tried by their
start. Pieces never cross a space, so texts fall apart into space-led words, and each distinct word
of a task is solved once.

Nulls and empty texts have 0 tokens. Characters outside the vocabulary count their UTF-8 bytes
if the vocabulary has byte pieces, else one unknown token for each run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_000_000
CACHE_WORD_CHARS = 64
BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file, in order of their ids."""
    import sentencepiece

    if not Path(path).exists():
        raise FileNotFoundError(f"no vocabulary at {path}")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class CountOnlyViterbi:
    """Counts the pieces of one space-led word; built once in each Python worker."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = sum(bool(BYTE_PIECE.fullmatch(p)) for p, _ in vocabulary) == 256
        self.single = frozenset(p for p, _ in vocabulary if len(p) == 1)
        self.known: dict[str, int] = {}

    def solve(self, word: str) -> int:
        n = len(word)
        if self.single.issuperset(word):  # no unknown character: every end has a path
            best, pieces = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for at, (size, score) in self.automaton.iter(word):  # longest first at each end: by start
                start = at + 1 - size
                score += best[start]
                if score > best[at + 1]:
                    best[at + 1], pieces[at + 1] = score, pieces[start] + 1
            return pieces[n]
        best, pieces, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)  # run: the path ends in an unknown character
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * (n + 1)
        for at, (size, score) in self.automaton.iter(word):
            ends[at + 1].append((at + 1 - size, score))
            single[at + 1] = single[at + 1] or size == 1
        for end in range(1, n + 1):
            top, count, unknown = None, 0, False
            for start, score in ends[end]:  # longest first: by start
                if top is None or best[start] + score > top:
                    top, count, unknown = best[start] + score, pieces[start] + 1, False
            if not single[end]:
                start, score = end - 1, best[end - 1] + self.unknown
                if top is None or score > top:
                    more = len(word[start].encode()) if self.bytes else int(not run[start])
                    top, count, unknown = score, pieces[start] + more, True
            best[end], pieces[end], run[end] = top, count, unknown
        return pieces[n]

    def word(self, word: str) -> int:
        if len(word) > CACHE_WORD_CHARS:
            return self.solve(word)
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[word] = self.solve(word)
        return found

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if not text.startswith(SPACE):
            text = SPACE + text
        total, known = 0, self.known
        for part in text.split(SPACE)[1:]:
            word = SPACE + part
            total += known[word] if word in known else self.word(word)
        return total


_model: dict[str, CountOnlyViterbi] = {}


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens bigint) for every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _model:
            _model[vocabulary] = CountOnlyViterbi(load_vocabulary(vocabulary))
        model = _model[vocabulary]
        for b in batches:
            counts = [model.text(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
