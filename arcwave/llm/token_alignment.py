"""Alignment of two tokenizers over the same bytes: groups of tokens, links between them, and which links are usual.

Each text is encoded by a byte-level BPE (A) and a SentencePiece model (B). Both sides of some texts lie one behind the other with the
texts' byte offsets: one ``bincount`` of the ends of A's tokens and one of B's tell every boundary; where both occur the
text is cut into groups. Every stretch between two neighbouring boundaries lies in one token of A and one of B, so it is a link, and no
other pair overlaps. Prefix sums over the marks, read at the texts' ends, give each text's counts.

A text's links are kept with it as packed pairs, so texts are encoded once. Counting pairs is a sum inside a task, then one shuffle of distinct
pairs; what is gathered grows with the corpus. The counts come back to the links as a sorted array, broadcast in slices of at
most ``SLICE_PAIRS`` pairs: with one slice for as long as the corpus has no more distinct pairs, else in as many passes over the links as
there are slices, each adding its part to the sums.

Texts that are null or empty, or whose tokens don't spell space + text on both sides, have no tokens: zeros. Strings of special tokens
inside a text are plain text. Texts of any length are encoded whole. Ties count: a link is among the best of its B token if its pair's count equals
the largest one. Repeated rows count as often as they stand. An empty table gives no rows. Columns that are not named are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.textkit import text_chunks
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import cut

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_PAIRS = 4_000_000
TASK_PAIRS = 4_000_000
ID_BITS = 16
CHUNK_LINKS = 500_000

# the pre-tokenizer of byte-level BPE files; a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE file: its tokens' bytes, and an encoder that knows no special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        self.pieces = {i: bytes(letters[c] for c in token) for token, i in held["model"]["vocab"].items() if all(c in letters for c in token)}
        special = {t["id"] for t in held.get("added_tokens", [])}
        merged = [held["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
        self.ranked = None
        if merged == sorted(merged) and (held.get("pre_tokenizer") or {}).get("type") == "ByteLevel":  # then ids are ranks
            import tiktoken

            self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={p: i for i, p in self.pieces.items() if i not in special}, special_tokens={})
        self.path, self.exact = path, None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.ranked is not None and not _LONG.search(text):
            return self.ranked.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
            self.exact.encode_special_tokens = True
        return self.exact.encode(text, add_special_tokens=False).ids


#: A run that one encoder takes in quadratic time or not at all; the other one takes it.
_LONG = re.compile(r"\S{10000}|\s{10000}")


class PieceModel:
    """A SentencePiece file: its pieces' bytes, and its encoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = _BYTE_PIECE.fullmatch(piece)
            self.pieces[i] = bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """One tokenizer's table of token sizes and of ids as decimal digits."""

    def __init__(self, coder: Any) -> None:
        self.coder, self.pieces = coder, coder.pieces
        top = max(self.pieces, default=0) + 1
        self.size = np.zeros(top, np.int64)
        for i, p in self.pieces.items():
            self.size[i] = len(p)
        self.wide = len(str(top))
        self.digits = np.array([str(i).ljust(self.wide) for i in range(top)], f"S{self.wide}").view(np.uint8).reshape(top, self.wide)
        self.places = np.array([len(str(i)) for i in range(top)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def marked(size: np.ndarray, ids: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of tokens that lie one behind the other, and how many end at each byte offset (0 or 1)."""
    ends = np.cumsum(size[ids])
    return ends, np.bincount(ends, minlength=total + 1).astype(np.int8)


def aligned(a: Side, b: Side, a_ids: list[list[int]], b_ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """For each text (both sides spell the same bytes): groups, links, the groups as text, and the links as packed pairs."""
    fa, fb = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a_ids, b_ids))
    na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    total = int(a.size[fa].sum())
    ends_a, mark_a = marked(a.size, fa, total)
    ends_b, mark_b = marked(b.size, fb, total)
    cuts = mark_a & mark_b
    upto_a, upto_b, upto_cut = (np.cumsum(m, dtype=np.int64) for m in (mark_a, mark_b, cuts))
    stops = np.concatenate([[0], ends_a])[np.cumsum(na)]  # the texts' ends in bytes
    before = np.concatenate([[0], stops[:-1]])
    groups = upto_cut[stops] - upto_cut[before]
    bounds = np.flatnonzero(mark_a | mark_b)
    first = fa[upto_a[bounds] - mark_a[bounds]] if len(bounds) else fa
    second = fb[upto_b[bounds] - mark_b[bounds]] if len(bounds) else fb
    pairs = ((first << ID_BITS) | second).astype(np.uint32)
    at = np.searchsorted(bounds, stops, "right")
    links = np.diff(np.concatenate([[0], at]))
    packed = [pairs[e - n : e].tobytes() for e, n in zip(at.tolist(), links.tolist(), strict=True)]
    # the text of a group: A's ids, then B's; so a token's place is its own plus what the other side has before it
    group_a, group_b = upto_cut[ends_a] - cuts[ends_a], upto_cut[ends_b] - cuts[ends_b]
    count = int(upto_cut[-1])
    held_a, held_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=count))]) for g in (group_a, group_b))
    place_a, place_b = np.arange(len(fa)) + held_b[group_a], np.arange(len(fb)) + held_a[group_b + 1]
    size = len(fa) + len(fb)
    wide = max(a.wide, b.wide)
    text, used = np.zeros((size, wide + 1), np.uint8), np.zeros(size, np.int64)
    text[place_a, : a.wide], used[place_a] = a.digits[fa], a.places[fa]
    text[place_b, : b.wide], used[place_b] = b.digits[fb], b.places[fb]
    text[place_a, used[place_a]] = np.where(cuts[ends_a], ord("|"), ord(","))
    text[place_b, used[place_b]] = np.where(cuts[ends_b], ord(";"), ord(","))
    flat = text[np.arange(wide + 1) <= used[:, None]]
    last = np.concatenate([[0], np.cumsum(used + 1)])[np.cumsum(na + nb)]
    begin = np.concatenate([[0], last[:-1]])
    return groups, links, [flat[x : max(x, y - 1)].tobytes() for x, y in zip(begin.tolist(), last.tolist(), strict=True)], packed


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(byte_bpe: str, piece_model: str) -> tuple[Side, Side]:
    """Both tokenizers, read once in each Python worker."""
    if (byte_bpe, piece_model) not in _sides:
        found = Side(ByteBpe(byte_bpe)), Side(PieceModel(piece_model))
        if max(len(s.size) for s in found) > 1 << ID_BITS:
            raise ValueError(f"ids of over {ID_BITS} bits")
        _sides[byte_bpe, piece_model] = found
    return _sides[byte_bpe, piece_model]


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups string, links binary) for every row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(byte_bpe, piece_model)
        for batch in batches:
            for first, end, buf, off in text_chunks(batch.column(1)):
                data = buf.tobytes()
                raw = [data[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                texts = [x.decode() for x in raw]
                ids_a, ids_b = a.encode([" " + t for t in texts]), b.encode(texts)
                for k, x in enumerate(raw):
                    whole = b" " + x
                    if not x or a.spell(ids_a[k]) != whole or b.spell(ids_b[k]) != whole:
                        ids_a[k], ids_b[k] = [], []
                groups, links, spelled, packed = aligned(a, b, ids_a, ids_b)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), *(pa.array([len(x) for x in ids], pa.int64()) for ids in (ids_a, ids_b)),
                    pa.array(groups, pa.int64()), pa.array(links, pa.int64()), pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(packed, pa.binary()),
                ], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary").withColumnRenamed("id", id_col)


def link_chunks(column: pa.Array, limit: int = CHUNK_LINKS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, pairs, offsets) of runs of rows with about ``limit`` packed pairs together; a longer row stands alone."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] // 4
    held = np.frombuffer(data, np.uint32, count=int(off[-1])) if data is not None else np.zeros(0, np.uint32)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, end, held[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair bigint, n bigint, best boolean) from a column ``links``: how many links hold each pair of ids, and whether its B id has no pair with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for _, _, links, _ in (x for b in batches for x in link_chunks(b.column(0))):
            fresh, n = np.unique(links, return_counts=True)
            held, at = np.unique(np.concatenate([held, fresh]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([count, n]), minlength=len(held)).astype(np.int64)
            if len(held) >= TASK_PAIRS:
                yield pa.RecordBatch.from_pydict({"pair": held.astype(np.int64), "n": count})
                held, count = held[:0], count[:0]
        yield pa.RecordBatch.from_pydict({"pair": held.astype(np.int64), "n": count})

    counts = cut(linked.select("links").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    second = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    top = counts.groupBy(second.alias("b")).agg(F.max("n").alias("top"))  # a row for each id of B
    return counts.withColumn("b", second).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def with_pair_counts(linked: DataFrame, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """``linked`` (a written table with a column ``links``) with n_best and count_sum, without the links."""
    spark = linked.sparkSession
    placed = cut(global_rank(pair_counts(linked), [F.col("pair")], "place"))
    total = placed.count()
    now = linked.withColumn("n_best", F.lit(0).cast("bigint")).withColumn("count_sum", F.lit(0).cast("bigint"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema)
    for low in range(0, total, slice_pairs):
        held = placed.filter((F.col("place") >= low) & (F.col("place") < low + slice_pairs)).orderBy("pair").select("pair", "n", "best").toArrow()
        known = spark.sparkContext.broadcast((held.column("pair").to_numpy().astype(np.uint32), held.column("n").to_numpy(), held.column("best").to_numpy()))
        now = (cut(now) if low else now).mapInArrow(_summed(known), kinds)
    return now.drop("links")


def _summed(known: Any) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for b in batches:
            more: dict[str, list[np.ndarray]] = {"count_sum": [], "n_best": []}
            for _, _, links, ends in link_chunks(b.column("links")):
                kinds, at = np.unique(links, return_inverse=True)
                place = np.minimum(np.searchsorted(pairs, kinds), len(pairs) - 1)
                hit = pairs[place] == kinds
                for name, values in (("count_sum", counts[place] * hit), ("n_best", best[place] & hit)):
                    more[name].append(np.diff(np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])[ends]))
            sums = {n: pa.array(b.column(n).to_numpy() + np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for n, x in more.items()}
            yield pa.RecordBatch.from_arrays([sums.get(n, b.column(n)) for n in b.schema.names], b.schema.names)

    return run


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return with_pair_counts(cut(found.withColumn("groups_sha256", digest).drop("groups")))
