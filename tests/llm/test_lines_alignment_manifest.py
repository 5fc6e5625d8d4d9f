"""Line deduplication, alignment of tokenizers and the Merkle manifest against plain versions of their definitions."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from arcwave.llm import line_dedup, merkle, token_alignment

BLANK = " \t\n\v\f\r"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(rng):
    shared = ["This line is found in many documents.", "  THIS LINE is found in many documents.\t", "only twenty code pts", "nineteen code point", "übergrößen ünd ähnliches, ganz öft", "\x0b\x0cwith odd blanks around it\r"]
    out = [None, "", "\n", "\n\n \n", "no line break here", "x" * 30_000 + "\n" + shared[0], shared[0], shared[0] + "\n" + shared[0]]
    for _ in range(60):
        out.append("\n".join(rng.choice([*shared, f"own line {rng.random()} of this text", "short"]) for _ in range(rng.randrange(1, 9))))
    return out


def without_lines(rows):
    """(id, lines, dropped, text) by the definition."""
    key = lambda line: lowered(line.strip(BLANK))
    held = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 20:
                    held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("narrow", [{}, {"filter_bytes": 0}, {"broadcast_keys": 0}, {"filter_bytes": 0, "broadcast_keys": 0}])
def test_lines_against_definition(spark, narrow, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_KEYS", 64)  # many blocks
    monkeypatch.setattr(line_dedup, "TASK_HASHES", 20)
    rng = random.Random(5)
    rows = list(enumerate(texts(rng)))
    rows += rows[6:12] + [(None, t) for _, t in rows[6:12]] + [(None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id bigint, text string, hash int, keep string").repartition(5)
    got = line_dedup.drop_lines(docs, **narrow)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    want = without_lines(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(w[3] for w in want) > 50


def test_lines_of_nothing(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], DOCS)).collect() == []
    got = line_dedup.drop_lines(spark.createDataFrame([(None, None), (None, "a\nb")], "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == [(None, "", 1, 0), (None, "a\nb", 2, 0)]


def test_filters_miss_nothing():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    table = pa.table({"block": [0, 0, 0], "once": [h[:3000].tobytes(), h[2000:].tobytes(), b""], "more": [b"", b"", h[:5].tobytes()]})
    out = line_dedup.twice_seen(table)
    found = line_dedup.Suspects(0, [(0, out.column("bits")[0].as_py(), out.column("filter")[0].as_py())])
    assert found.has(h[2000:3000]).all() and found.has(h[:5]).all()
    assert found.has(h[3000:]).mean() < 0.02
    assert not line_dedup.Suspects(2, []).has(h).any()


# alignment


def aligned_plainly(a, b, text):
    """(A ids, B ids, groups as text, links) by comparing byte ranges."""
    ids_a, ids_b = (a.encode([" " + text])[0], b.encode([text])[0]) if text else ([], [])
    whole = (" " + (text or "")).encode()
    if a.spell(ids_a) != whole or b.spell(ids_b) != whole:
        return [], [], "", []
    ranges = []
    for side, ids in ((a, ids_a), (b, ids_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(side.pieces[i]), i))
            at = out[-1][1]
        ranges.append(out)
    both = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
    groups, low = [], 0
    for high in both:
        groups.append("|".join(",".join(str(i) for s, e, i in side if s >= low and e <= high) for side in ranges))
        low = high
    links = [(i, j) for s, e, i in ranges[0] for p, q, j in ranges[1] if s < q and p < e]
    return ids_a, ids_b, ";".join(groups), links


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nbreak\r\n", "naïve façade — “quotes” … 東京 🙂🙂", "<|endoftext|> and <s> </s> <unk>", "▁ a word-start sign", "nul\x00byte", "Donaudampfschifffahrtsgesellschaft 1234567 !!!???", "the the the the", "the the the the"]


@pytest.mark.parametrize("slice_pairs", [token_alignment.SLICE_PAIRS, 7])
def test_alignment_against_byte_ranges(spark, slice_pairs):
    from arcwave.plans.lineage import cut

    rng = random.Random(3)
    words = ["".join(rng.choice(["ba", "ton", "über", "s", "ing", "la", "é"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    held = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(20)]
    rows = list(enumerate(held)) + [(3, held[3]), (None, "no id at all")]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id bigint, text string, links binary").repartition(3)
    linked = cut(token_alignment.align(docs))
    got = token_alignment.with_pair_counts(linked, slice_pairs)
    a, b = token_alignment.sides(token_alignment.BYTE_BPE, token_alignment.PIECE_MODEL)
    plain = [(i, *aligned_plainly(a, b, t)) for i, t in rows]
    count = Counter(x for *_, links in plain for x in links)
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    want = [(i, len(x), len(y), g.count("|"), len(l), g, sum(count[p] == top[p[1]] for p in l), sum(count[p] for p in l)) for i, x, y, g, l in plain]
    found = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    zeros = [w[0] for w in want if not w[1]]
    assert 0 in zeros and 1 in zeros and 7 not in zeros


def test_both_byte_encoders_agree(spark, sf_dir):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(token_alignment.BYTE_BPE)
    exact.encode_special_tokens = True
    side = token_alignment.ByteBpe(token_alignment.BYTE_BPE)
    assert side.ranked is not None
    held = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()] + [t for t in ODD if t] + [f"it's we'll I'd  x{chr(c)}y {chr(c)}" for c in range(0xA0, 0x2FF0, 37)]
    assert side.encode([" " + t for t in held]) == [x.ids for x in exact.encode_batch([" " + t for t in held], add_special_tokens=False)]


def test_alignment_of_long_runs(spark):
    rows = [(1, "a" * 60_000), (2, " " * 30_000 + "end"), (3, "word " * 20_000)]
    got = {r.doc_id: r for r in token_alignment.align(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups > 0 for i in got)
    none = spark.createDataFrame([], DOCS)
    from arcwave.plans.lineage import cut

    assert token_alignment.with_pair_counts(cut(token_alignment.align(none))).collect() == []


# manifest


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def rise(nodes):
    """The root of a list of digests, and each one's siblings by level."""
    siblings = [[] for _ in nodes]
    below = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for k in range(len(run)):
                for x in below[s + k]:
                    siblings[x].append((run[:k], run[k + 1 :]))
            up.append(digest("".join(run)))
            under.append([x for k in range(len(run)) for x in below[s + k]])
        nodes, below = up, under
    return nodes[0], siblings


def manifest_plainly(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        held = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = (held, *rise([leaf_of(r) for r in held]))
    root, above = rise([trees[g][1] for g in order])
    out = []
    for k, g in enumerate(order):
        held, subroot, siblings = trees[g]
        for r, own in zip(held, siblings, strict=True):
            path = own + above[k]
            node = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf_of((*r[:4], lowered(r[4])))
            for lo, hi in path:
                node = digest("".join([*lo, node, *hi]))
            out.append((r[0], leaf_of(r), subroot, root, digest("".join(x for lo, hi in path for x in [*lo, *hi])), node, node == root))
    return sorted(out, key=repr)


def manifest_of(spark, tmp_path, rows):
    """The query over a table of (doc_id, source, lang, n_chars, text)."""
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    docs.withColumn("leaf", F.lit("own")).withColumn("part", F.lit(1)).withColumn("PROOF", F.lit(None).cast("binary")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path))
    return sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (1, 1, 64, 65), (3, 130)])
def test_manifest_against_definition(spark, tmp_path, sizes):
    rows = [(10 * g + 1000 * k, "src", f"l{g}", k, f"Text {k} of {g}") for g, n in enumerate(sizes) for k in range(n)]
    assert manifest_of(spark, tmp_path, rows) == manifest_plainly(rows)


def test_manifest_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "s", None, 3, "abc"), (7, "s", None, 3, "abc"), (7, "s", None, 3, "ABC"), (8, "s", "", 0, ""), (9, "ü", "de", 1, "Ä" * 50_000), (10, "-", "de", None, "9:x"), (11, "", "zz", 5, None)]
    got = manifest_of(spark, tmp_path, rows)
    assert got == manifest_plainly(rows)
    assert {g[6] for g in got} == {True, False}


def test_small_blocks_need_several_traversals(spark):
    """With blocks of 8 leaves 150 rows take three distributed traversals; the tree is the same."""
    rows = [(k, "ab"[k > 140], sha256(bytes([k])).digest()) for k in range(150)]
    leaves = spark.createDataFrame(rows, "id bigint, part string, leaf binary").withColumn("claimed", F.col("leaf"))
    tall = merkle.folded(merkle.manifest(leaves, levels=1))
    flat = merkle.folded(merkle.manifest(leaves))
    assert tall.filter("folded <> root").isEmpty() and tall.count() == 150
    assert tall.exceptAll(flat).isEmpty()


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest_of(spark, tmp_path, []) == []
