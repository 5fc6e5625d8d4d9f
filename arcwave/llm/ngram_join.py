"""N-gram Jaccard self-join with signature trees, and its connected components.

A text's set is its distinct word 5-grams. Rows with equal sets are one node. Nodes meet in buckets of shared tokens.
A set of at most ``FULL`` tokens posts an exact prefix: of two linked sets of n tokens or more, the first n - ceil(0.75 n) + 1
tokens of each in any one order share one. The order is by hash, with the tokens that over ``HOT`` sets post, mostly among colder ones,
behind all others: so a line that very many texts hold brings none of them together unless it makes up most of them.

Larger sets post their ``SKETCH`` smallest tokens (those of up to ``FULL`` and over 4 * ``SKETCH`` tokens post these too, if their prefix
changed). Two of them of Jaccard similarity 0.75 have no bucket in common with
probability under 0.25 ** 32, which is less than that of a collision among their 64-bit hashes. They leave buckets of over ``HOT``
nodes if they have at most ``SPARE`` such buckets: linked
sets share over ``SPARE`` tokens but for odds under 1e-9, so a cooler bucket brings them together. ``exact=True`` posts exact
prefixes for sets of all sizes instead (a quarter of all tokens), and none leaves a bucket.

Inside a bucket a signature tree holds OR- and AND-combined token bitmaps and size ranges; a dual
traversal drops node pairs whose largest possible overlap is too small, and leaves give candidate pairs.
Candidates are verified on the whole texts.

Round 1 lets a bucket with many candidates return a spanning set of them only. What that verifies gives
components; round 2 returns to these buckets and takes every candidate between different components, so no
link between components is left out. Buckets of over ``BLOCK`` nodes are cut into blocks: in round 1 each
block stands alone beside one common node, in round 2 rows outside the bucket's main component meet all blocks.

Null and empty texts, and texts without words, link with nothing, as do rows without an id. An empty table gives no rows. Each row is
judged by its own text, also where ids repeat. Row keys are hashes of id and text. A pair at exactly the similarity links, and of ids
that tie the smallest names the component. A task holds 1 MB of text, or one longer text, at a time. Input columns of any other name are
not read by ``similar_components`` and come through ``keep_one`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from arcwave.llm.textkit import mix, shingle_hashes, slices, text_chunks, word_hashes
from arcwave.operators.components import connected_components
from arcwave.plans.lineage import cut
from arcwave.plans.names import free
from arcwave.plans.spread import small, spread_join

WORDS = 5
NUM, DEN = 3, 4  # the similarity, as a fraction
SKETCH = 32
FULL = 4 * SKETCH * DEN // NUM
HOT, SPARE = 1000, 4
BLOCK = 2048
LEAF, FAN = 32, 4
WIDE = 8  # bits per token of round 2's bitmaps: pairs just under the similarity are many in a group of near copies
BROADCAST_IDS = 1_000_000


def text_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, buf, off in text_chunks(column):
        hashes, _, _, first = word_hashes(buf, off)
        runs, begin = shingle_hashes(hashes, first, words)
        for i in range(len(off) - 1):
            yield np.unique(runs[begin[i] : begin[i + 1]])


def prefix_length(n: int) -> int:
    """So many of the smallest tokens of two sets of this similarity and at least this size must share one."""
    return n - -(-NUM * n // DEN) + 1


def bitmap(tokens: np.ndarray, factor: int = 1) -> bytes:
    """One bit per token, in the least power of two of bits that is ``factor`` times the set, 64 at least."""
    bits = max(64, 1 << max(0, int(factor * len(tokens) - 1)).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(tokens >> np.uint64(7)) & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _linkable(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return (NUM + DEN) * overlap >= NUM * (na + nb)


class SignatureTree:
    """Rows sorted by size under nodes that hold size ranges and OR- and AND-combined bitmaps; level 0 has the leaves."""

    def __init__(self, n: np.ndarray, bits: np.ndarray) -> None:
        self.order = np.argsort(n, kind="stable")
        self.n, self.bits = n[self.order], bits[self.order]
        heads = np.arange(0, len(n), LEAF)
        ends = np.append(heads[1:], len(n))
        level = (self.n[heads], self.n[ends - 1], np.bitwise_or.reduceat(self.bits, heads), np.bitwise_and.reduceat(self.bits, heads))
        self.levels = [level]
        while len(level[0]) > 1:
            heads = np.arange(0, len(level[0]), FAN)
            ends = np.append(heads[1:], len(level[0]))
            level = (level[0][heads], level[1][ends - 1], np.bitwise_or.reduceat(level[2], heads), np.bitwise_and.reduceat(level[3], heads))
            self.levels.append(level)


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether some rows below nodes i and j may link: their sizes and the tokens that all rows of one side have and none of the other."""
    alo, ahi, aor, aand = a[0][i], a[1][i], a[2][i], a[3][i]
    blo, bhi, bor, band = b[0][j], b[1][j], b[2][j], b[3][j]
    fits = (DEN * ahi >= NUM * blo) & (DEN * bhi >= NUM * alo)
    lost_a = np.bitwise_count(aand & ~bor).sum(axis=1, dtype=np.int64)
    lost_b = np.bitwise_count(band & ~aor).sum(axis=1, dtype=np.int64)
    # overlap <= size - lost on either side, and must be 3/7 of both sizes: with x <= ahi, 4 x >= 3 y + 7 lost_a, or x alone
    return fits & (DEN * ahi - (NUM + DEN) * lost_a >= NUM * blo) & (DEN * bhi - (NUM + DEN) * lost_b >= NUM * alo)


def dual_traversal(a: SignatureTree, b: SignatureTree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate pairs of rows (places before sorting) and the most Jaccard similarity that each may have; with ``same``, each unordered pair once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        good = _possible(a.levels[la], b.levels[lb], i, j)
        if same:
            good &= i <= j
        i, j = i[good], j[good]
        if la == 0 and lb == 0:
            break
        if la >= lb:
            la, kids = la - 1, len(a.levels[la - 1][0])
            i, j = (FAN * i[:, None] + np.arange(FAN)).reshape(-1), np.repeat(j, FAN)
            i, j = i[i < kids], j[i < kids]
        if same or lb > la:
            lb, kids = lb - 1, len(b.levels[lb - 1][0])
            j, i = (FAN * j[:, None] + np.arange(FAN)).reshape(-1), np.repeat(i, FAN)
            i, j = i[j < kids], j[j < kids]
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        x, y = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
        na, nb, ba, bb = a.n[x], b.n[y], a.bits[x], b.bits[y]
        common = ba[:, None, :] & bb[None, :, :]
        shared = np.bitwise_count(common).sum(axis=2, dtype=np.int64)
        most = np.minimum((na - np.bitwise_count(ba).sum(axis=1, dtype=np.int64))[:, None] + shared, (nb - np.bitwise_count(bb).sum(axis=1, dtype=np.int64))[None, :] + shared)
        good = _linkable(most, na[:, None], nb[None, :])
        if same and p == q:
            good &= np.tri(*good.shape, -1, dtype=bool).T
        r, c = np.nonzero(good)
        if len(r):
            overlap = most[r, c]
            yield a.order[x][r], b.order[y][c], overlap / np.maximum(na[r] + nb[c] - overlap, 1)


def _bits(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` or 2 * ``width`` bytes as 64-bit words, the longer ones folded."""
    out = np.empty((len(maps), width // 8), np.uint64)
    for k, m in enumerate(maps):
        words = np.frombuffer(m, np.uint64)
        out[k] = words if len(m) == width else words[: width // 8] | words[width // 8 :]
    return out


def candidate_pairs(n: np.ndarray, maps: list[bytes], left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates and their likeness among rows ``left``, or between ``left`` and ``right``. Linkable sizes have widths equal or twofold, so widths meet in turn."""
    width = np.fromiter((len(m) for m in maps), np.int64, len(maps))
    tree = lambda rows, w: SignatureTree(n[rows], _bits([maps[k] for k in rows.tolist()], w))
    other = left if right is None else right
    for w in np.unique(width[left]).tolist():
        a = left[width[left] == w]
        if right is None:
            t = tree(a, w)
            for x, y, like in dual_traversal(t, t, True):
                yield a[x], a[y], like
        for v in ((2 * w,) if right is None else (w // 2, w, 2 * w)):
            b = other[width[other] == v]
            if len(b):
                for x, y, like in dual_traversal(tree(a, min(v, w)), tree(b, min(v, w)), False):
                    yield a[x], b[y], like


def spanning(m: int, x: np.ndarray, y: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of pairs (x, y) over m rows, of the most likeness: its pairs are likely links, and buckets of much the same rows choose the same."""
    weight = np.zeros((m, m), np.float32)
    weight[x, y] = weight[y, x] = like
    near, up = np.zeros(m, np.float32), np.full(m, -1)
    free = np.ones(m, bool)
    a, b = [], []
    for _ in range(m):
        v = int(np.argmax(np.where(free, near, -1)))
        if near[v] > 0:
            a.append(up[v])
            b.append(v)
        free[v] = False
        better = free & (weight[v] > near)
        near[better], up[better] = weight[v][better], v
    return np.array(a, np.int64), np.array(b, np.int64)


def _small_bucket(n: list[int], maps: list[bytes]) -> tuple[list[int], list[int], list[float]]:
    """All candidates of a few rows and their likeness, compared as integers."""
    whole = [int.from_bytes(m, "little") for m in maps]
    a, b, like = [], [], []
    for i in range(len(n)):
        for j in range(i):
            x, y, p, q = i, j, n[i], n[j]
            if DEN * p < NUM * q or DEN * q < NUM * p:
                continue
            u, v, wu, wv = whole[x], whole[y], len(maps[x]), len(maps[y])
            if wu > wv:
                u = (u & (1 << 8 * wv) - 1) | u >> 8 * wv
            elif wv > wu:
                v = (v & (1 << 8 * wu) - 1) | v >> 8 * wu
            shared = (u & v).bit_count()
            most = min(p - u.bit_count() + shared, q - v.bit_count() + shared)
            if (NUM + DEN) * most >= NUM * (p + q):
                a.append(i)
                b.append(j)
                like.append(most / (p + q - most))
    return a, b, like


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns; the input is sorted by them."""
    rest: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        cols = [table.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(table.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        if rest and any(rest[-1].column(k)[-1].as_py() != cols[k][0] for k in range(keys)):
            yield pa.concat_tables(rest)
            rest = []
        for s, e in zip(cuts[:-2], cuts[1:-1], strict=True):
            part = table.slice(s, e - s)
            if rest:
                part, rest = pa.concat_tables([*rest, part]), []
            yield part
        rest.append(table.slice(cuts[-2]))
    if rest:
        yield pa.concat_tables(rest)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tok", pa.int64())])


def _emit(rows: list[tuple[np.ndarray, np.ndarray]], open_: list[int]) -> pa.RecordBatch:
    a = np.concatenate([np.zeros(0, np.int64), *(np.minimum(x, y) for x, y in rows)])
    b = np.concatenate([np.zeros(0, np.int64), *(np.maximum(x, y) for x, y in rows)])
    blank = pa.nulls(len(open_), pa.int64())
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), blank]), pa.concat_arrays([pa.array(b), blank]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(open_, pa.int64())])], schema=PAIR)


def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, block, blocks, node, n, bm) -> candidate pairs (a, b), or the tokens whose bucket needs round 2."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    open_: list[int] = []
    size = 0
    for t in _groups(batches, 2):
        m = t.num_rows
        tok, blocks = t.column(0)[0].as_py(), t.column(2)[0].as_py()
        if blocks > 1:
            open_.append(tok)
        if m > 1:
            node, maps = t.column(3).to_numpy(), t.column(5).to_pylist()
            if m <= 12:
                x, y, like = (np.array(v) for v in _small_bucket(t.column(4).to_pylist(), maps))
            else:
                found = list(candidate_pairs(t.column(4).to_numpy(), maps, np.arange(m)))
                x, y, like = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            if len(x) > m:
                x, y = spanning(m, x, y, like)
                open_ += [tok] * (blocks == 1)
            if len(x):
                rows.append((node[x], node[y]))
                size += len(x)
        if size + len(open_) > 50_000:
            yield _emit(rows, open_)
            rows, open_, size = [], [], 0
    yield _emit(rows, open_)


def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, r, q, col, minor, node, n, wide, label, toks) -> all candidates between different labels of rows (col false) and columns (col true).

    ``toks`` has all buckets of a node in this round; a pair comes from the least one that it shares.
    """
    for t in _groups(batches, 3):
        col, minor = t.column(3).to_numpy(zero_copy_only=False), t.column(4).to_numpy(zero_copy_only=False)
        node, n, maps, label = t.column(5).to_numpy(), t.column(6).to_numpy(), t.column(7).to_pylist(), t.column(8).to_numpy()
        left, right = np.flatnonzero(~col), np.flatnonzero(col)
        if not len(left) or not len(right):
            continue
        rows, held, tok = [], {}, t.column(0)[0].as_py()
        for x, y, _ in candidate_pairs(n, maps, left, right):
            good = (label[x] != label[y]) & (~minor[x] | (node[x] < node[y]))
            x, y = x[good], y[good]
            for k in {*x.tolist(), *y.tolist()} - held.keys():
                held[k] = frozenset(t.column(9)[k].as_py())
            here = np.fromiter((min(held[p] & held[q]) == tok for p, q in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
            if here.any():
                rows.append((node[x[here]], node[y[here]]))
        if rows:
            yield _emit(rows, [])


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str, exact: bool = False) -> DataFrame:
    """(id, key, n, k1, k2, toks, want, capped, bm, wide) for every row; ``want`` is the length of the prefix, ``toks`` all tokens unless ``capped``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            n, k1, k2, toks, wants, capped, maps, wide = [], [], [], [], [], [], [], []
            for s in text_sets(b.column(2), words):
                size = len(s)
                n.append(size)
                k1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                k2.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5BF03635))).view(np.int64)) if size else 0)
                want = prefix_length(size) if size else 0
                cap = size > FULL and not exact
                toks.append((s[:SKETCH] if cap else s).view(np.int64))
                wants.append(SKETCH if cap else want)
                capped.append(cap)
                maps.append(bitmap(s))
                wide.append(bitmap(s, WIDE))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in toks])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *toks])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists, pa.array(wants, pa.int32()), pa.array(capped, pa.bool_()), pa.array(maps, pa.binary()), pa.array(wide, pa.binary())], ["id", "key", "n", "k1", "k2", "toks", "want", "capped", "bm", "wide"])

    return rows.mapInArrow(run, f"id {kind}, key bigint, n bigint, k1 bigint, k2 bigint, toks array<bigint>, want int, capped boolean, bm binary, wide binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("id", "text").alias("key"), "text")


def verified(docs: DataFrame, pairs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of row keys whose whole texts link."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    wanted = small(ids, BROADCAST_IDS)
    held = cut(_keyed(docs, id_col, text_col).select("key", "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    both = pairs.join(held.withColumnsRenamed({"key": "a", "text": "ta"}), "a").join(held.withColumnsRenamed({"key": "b", "text": "tb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                keys, first = np.unique(np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()]), return_index=True)
                texts = pa.concat_arrays([part.column(2), part.column(3)]).take(pa.array(first))
                sets = dict(zip(keys.tolist(), text_sets(texts, words), strict=True))
                good = []
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    overlap = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    good.append(bool(_linkable(overlap, len(sets[x]), len(sets[y]))))
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _buckets(rows: DataFrame, keys: list[str], run: Callable, columns: list[str]) -> DataFrame:
    # nodes in order: buckets of the same nodes then span them in the same way, so they verify the same pairs
    return rows.select(columns).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a bigint, b bigint, tok bigint")


def _posted(reps: DataFrame) -> DataFrame:
    """(node, capped, tok): the buckets of each node."""
    prefix = cut(reps.select("node", "capped", F.explode(F.slice("toks", F.lit(1), F.col("want"))).alias("tok")))
    hot = cut(prefix.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT).select("tok", F.lit(1).alias("hot")))
    if hot.isEmpty():
        return prefix
    # tokens of large groups of near copies stay in their place: the prefixes that hold them are mostly hot
    share = F.avg(F.coalesce("hot", F.lit(0))).over(Window.partitionBy("node"))
    seen = prefix.join(small(hot), "tok", "left").withColumn("share", share).filter("hot = 1")
    line = cut(seen.groupBy("tok").agg(F.avg("share").alias("share")).filter("share <= 0.5").select("tok"))
    # the order is fixed for all nodes; it changes the prefixes that hold such a token
    changed = cut(prefix.filter("not capped").join(small(line), "tok", "left_semi").select("node").distinct())
    if changed.isEmpty():
        return prefix
    held = reps.join(small(changed, BROADCAST_IDS), "node", "left_semi")
    behind = held.select("node", F.explode("toks").alias("tok")).join(small(line), "tok").groupBy("node").agg(F.collect_set("tok").alias("line"))
    ordered = F.slice(F.concat(F.array_except("toks", "line"), F.array_intersect("toks", "line")), F.lit(1), F.col("want"))
    both = F.when(F.col("n") > 4 * SKETCH, F.array_union(ordered, F.slice("toks", 1, SKETCH))).otherwise(ordered)
    moved = held.join(behind, "node").select("node", "capped", F.explode(both).alias("tok"))
    return cut(prefix.join(small(changed, BROADCAST_IDS), "node", "left_anti").unionByName(moved))


def similar_components(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(id, key bigint, n_shingles bigint, component_id) for every row; component_id is the smallest id reachable by links."""
    rows = cut(sketches(docs, words, id_col, text_col, exact))
    classes = cut(rows.filter("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("least"), F.min("key").alias("node")))
    nodes = small(classes.select(F.col("node").alias("key")), BROADCAST_IDS)
    reps = cut(rows.filter("id is not null").select("key", "n", "toks", "want", "capped").join(nodes, "key", "left_semi").dropDuplicates(["key"]).withColumnRenamed("key", "node"))

    def maps(of: DataFrame, column: str) -> DataFrame:
        """(node, n, map) of the nodes ``of``: only what meets another has its bitmap shuffled."""
        wanted = small(cut(of.select(F.col("node").alias("key")).distinct()), BROADCAST_IDS)
        return rows.select("key", "n", column).join(wanted, "key", "left_semi").dropDuplicates(["key"]).withColumnRenamed("key", "node")

    posted = _posted(reps)
    shared = cut(posted.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    met = spread_join(posted, shared, ["tok"], "node", task_rows=4 * HOT, counts=shared.withColumnRenamed("c", "n")).withColumn("hot", F.col("c") > HOT)
    spare = F.sum(F.col("hot").cast("int")).over(Window.partitionBy("node")) <= SPARE  # the buckets of one node
    met = cut(met.withColumn("leaves", F.col("capped") & F.col("hot") & spare).filter("not leaves").select("tok", "c", "node"))
    met = met.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    common = met.filter("blocks > 1").groupBy("tok").agg(F.min("node").alias("node")).withColumn("everywhere", F.lit(True))
    placed = met.join(common, ["tok", "node"], "left")
    placed = placed.withColumn("block", F.explode(F.when(F.col("everywhere"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    placed = placed.join(maps(met, "bm"), "node")
    found = cut(_buckets(placed, ["tok", "block"], first_round, ["tok", "block", "blocks", "node", "n", "bm"]))
    pairs = found.filter("tok is null").select("a", "b").distinct()
    links = cut(verified(docs, pairs, words, id_col, text_col))

    again = cut(found.filter("tok is not null").select("tok").distinct())
    if not again.isEmpty():
        label = connected_components(links).select("node", F.col("component").alias("label"))
        named = met.join(small(again), "tok", "left_semi").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = cut(named)
        buckets = named.groupBy("node").agg(F.collect_list("tok").alias("toks"))  # at most SKETCH a node
        counts = named.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("tok").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all")).filter("main.n < all")
        main = main.select("tok", F.col("main.label").alias("most"), F.ceil(F.col("all") / BLOCK).cast("int").alias("rs"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("qs"), F.col("all").alias("n"))
        main = cut(main)  # one row a bucket
        split = spread_join(named, main.drop("n"), ["tok"], "node", task_rows=4 * HOT, counts=main.select("tok", "n")).withColumn("minor", F.col("label") != F.col("most"))
        part = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
        spread = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        as_row = split.withColumn("r", part("rs")).withColumn("q", spread("qs")).withColumn("col", F.lit(False))
        as_col = split.filter("minor").withColumn("q", part("qs")).withColumn("r", spread("rs")).withColumn("col", F.lit(True))
        tasks = as_row.unionByName(as_col).join(maps(named, "wide").join(buckets, "node"), "node")
        more = _buckets(tasks, ["tok", "r", "q"], second_round, ["tok", "r", "q", "col", "minor", "node", "n", "wide", "label", "toks"])
        more = cut(more.select("a", "b").distinct())
        if not more.isEmpty():
            links = links.unionByName(verified(docs, more, words, id_col, text_col))
            links = cut(links)

    component = connected_components(links)
    named = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "component").select("k1", "k2", "n", "component_id", F.lit(True).alias("known"))
    out = rows.select("id", "key", "n", "k1", "k2").join(by_class, ["k1", "k2", "n"], "left")
    linked = F.col("known") & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that of the smallest id, and of the smallest text key where it repeats. Rows without an id or without words stay."""
    name = free(docs, "key")
    found = cut(similar_components(docs, words, id_col, text_col).withColumnsRenamed({id_col: "id", "key": name}))
    grouped = found.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    first = grouped.groupBy("component_id").agg(F.min(F.struct("id", name)).alias("first")).select(F.col(f"first.{name}").alias(name))
    loose = found.filter((F.col("n_shingles") == 0) | F.col("id").isNull()).select(name).distinct()
    keyed = docs.withColumn(name, F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))
    kept = keyed.join(first, name, "left_semi").dropDuplicates([name])
    return kept.unionByName(keyed.join(loose, name, "left_semi")).select(docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_components(docs).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive toks as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) end s from toks
), texts as materialized (
  select min(doc_id) rep, list(doc_id) ids, list_sort(s) s from sets where len(s) > 0 group by list_sort(s)
), grams as materialized (
  select rep, len(s) n, unnest(s) g from texts
), links as materialized (
  select a.rep a, b.rep b from grams a join grams b on a.g = b.g and a.rep <> b.rep
  where 4 * a.n >= 3 * b.n and 4 * b.n >= 3 * a.n
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), named as (
  select unnest(ids) doc_id, least(rep, coalesce((select min(b) from reach where a = rep), rep)) c from texts
)
select s.doc_id, len(s.s)::bigint n_shingles, coalesce(n.c, s.doc_id) component_id from sets s left join named n on s.doc_id = n.doc_id
"""
