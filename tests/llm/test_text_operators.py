"""Operators on texts, each against a brute-force version; odd rows for all of them."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from arcwave.llm import decontamination, embedding_dedup, ngram_join, packing, pii, secret_scan, sharding, substring_dedup, textkit, token_counts, toxicity

ODD = [(1, "One two three four five six."), (1, "One two three four five six."), (2, None), (3, ""), (None, "one two three four five six seven"), (4, " \n\t "), (5, "x" * 50_000), (6, "é 日本 \U0001f600 ß")]


def frame(spark, rows, extra=True):
    """Rows with columns that clash with the operators' own names."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    names = "doc_id bigint, text string, score string, key string, n bigint, g bigint, id bigint, source string"
    return spark.createDataFrame([(a, b, "s", "k", 7, 7, 7, None) for a, b in rows], names)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_words_and_shingles():
    texts = ["a b c d e f a b c d e", "", "  A\tb\n", "x", "É é", "q" * 3000, "a b c d e", "A b c D e"]
    column = pa.array(texts)
    sets = list(ngram_join.text_sets(column))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[6].tolist() == sets[7].tolist() and set(sets[6].tolist()) <= set(sets[0].tolist())
    for limit in (1, 10, 1 << 20):
        got = np.concatenate([np.diff(textkit.word_spans(buf, off)[2]) for _, _, buf, off in textkit.text_chunks(column, limit)])
        assert got.tolist() == [len(words(t)) for t in texts]


# 1: n-gram join


def components(texts):
    sets, p = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def similar_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(10):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t + rng.choices(vocabulary, k=rng.choice([0, 0, 1, 5, 20]))))
    return [*out, "", None, "one", "A b C d", "a B c D"]


def test_ngram_join_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HOT", 10)
    texts = similar_texts(1)
    found = ngram_join.similar_components(frame(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(components(texts)))
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {k: len(shingles(t)) for k, t in enumerate(texts)}


def test_ngram_join_odd_rows(spark):
    docs = frame(spark, ODD)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()), key=str)
    assert (1, 2, 1) in found and (2, 0, 2) in found and (3, 0, 3) in found and (4, 0, 4) in found and (None, 3, None) in found
    assert len(found) == len(ODD)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 1
    assert ngram_join.similar_components(docs.limit(0)).count() == 0


def test_loose_rows_stay_as_they_are(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (None, None), (None, None), (1, ""), (1, ""), (2, None), (3, text), (3, text), (4, text), (5, "eight nine ten")]
    kept = ngram_join.keep_one(frame(spark, rows))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([*rows[:8], (5, "eight nine ten")], key=repr)


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, 80).astype(np.uint64) for _ in range(5)]
    sets = []
    for k in range(200):
        s = base[k % 5].copy()
        hit = rng.random(80) < rng.choice([0.02, 0.1, 0.2, 0.5])
        s[hit] = rng.integers(0, 2**63, int(hit.sum())).astype(np.uint64)
        sets.append(np.unique(s[: rng.integers(40, 81)]))
    n = np.array([len(s) for s in sets])
    for factor in (1, 8):
        maps = [ngram_join.bitmap(s, factor) for s in sets]
        found = {(min(a, b), max(a, b)) for x, y, _ in ngram_join.candidate_pairs(n, maps, np.arange(200)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        across = {(a, b) for x, y, _ in ngram_join.candidate_pairs(n, maps, np.arange(100), np.arange(100, 200)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        linked = set()
        for a, b in itertools.combinations(range(200), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (n[a] + n[b] - both):
                linked.add((a, b))
        assert linked and linked <= found
        assert {(a, b) for a, b in linked if a < 100 <= b} <= across


# 2: embeddings


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 16)), 5, axis=0) + rng.normal(size=(150, 16)) * rng.choice([0.0, 0.02, 0.2], size=(150, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (None, x[0].tolist()), (204, [1.0, 2.0])]
    found = embedding_dedup.near_duplicates(spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    truth = int(links.sum()) - 150
    got = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
    total = sum(r["n_links"] for r in got.values())
    assert 0.9 * truth <= total <= truth
    assert all(got[k]["n_links"] <= int(links[k].sum()) - 1 for k in range(150))
    for r in found:
        if r["vec_id"] is None or r["vec_id"] >= 200:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


# 3: secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train(spark)


def test_forest_holds_out(spark, forest):
    rows = secret_scan.labelled_findings(600, seed=99)
    describe = secret_scan.Describer().features
    from pyspark.ml.functions import array_to_vector

    frame_ = spark.createDataFrame([(describe(*r[:4]), float(r[4])) for r in rows], "x array<double>, label double").withColumn("features", array_to_vector("x"))
    assert forest.transform(frame_).filter("prediction = label").count() >= 0.95 * len(rows)


def test_secrets_are_redacted(spark, forest):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [*ODD, (20, f'é start token = "{key}" end'), (21, f"see commit {key} in the log"), (22, "plain words of no interest at all"), (23, f'TOKEN = "{key.upper()}"!! and token = "{key}"')]
    docs = frame(spark, rows)
    found = secret_scan.scan(docs, forest)
    secrets = sorted((r["doc_id"], r["start"], r["end"]) for r in found.filter("secret").collect())
    assert secrets == [(20, 17, 57), (23, 9, 49), (23, 66, 106)]
    clean = secret_scan.redact(docs, found)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[20] == 'é start token = "[SECRET]" end' and texts[21] == rows[-3][1] and texts[5] == "x" * 50_000
    assert secret_scan.scan(docs.limit(0), forest).count() == 0


def test_unquoted_assignments(spark, forest):
    aws, hub = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzR4q8vT2nLs", "ghp_" + "a8Kd03LmQz7TyRw1XcVb9NpU5sHj2GfE4iOo"
    rows = [(1, f"AWS_SECRET_ACCESS_KEY={aws}"), (2, f"export API_KEY={hub}\nnext"), (3, "token=abcd1234efgh5678"), (4, "a password=Tr0ub4dor&3xyz! b"), (5, f"STRIPE={hub}"), (6, "QUJDREVGR0hJSktMTU5P1Q=="), (7, "pin_of_door=a1b2c3d4")]
    want = {1: [aws], 2: [hub], 3: ["abcd1234efgh5678"], 4: ["Tr0ub4dor&3xyz!"], 5: [hub], 6: ["QUJDREVGR0hJSktMTU5P1Q=="], 7: ["a1b2c3d4"]}
    assert {k: [t[s:e] for s, e in secret_scan.candidates(t)] for k, t in rows} == want
    docs = frame(spark, rows)
    found = secret_scan.scan(docs, forest)
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, found).collect()}
    assert clean[1] == "AWS_SECRET_ACCESS_KEY=[SECRET]" and clean[2] == "export API_KEY=[SECRET]\nnext" and clean[5] == "STRIPE=[SECRET]"
    assert clean[4] in (rows[3][1], "a password=[SECRET] b")


def test_passphrases_and_url_passwords(spark, forest):
    url = "postgres://admin:Sup3rS3cret99@db.internal:5432/main"
    assert [url[s:e] for s, e in secret_scan.candidates(url)][:1] == ["Sup3rS3cret99"]
    both = "auth_url=redis://svc:h0ney-comb@cache:6379/0 see http://host:8080/path@x"
    assert "h0ney-comb" in [both[s:e] for s, e in secret_scan.candidates(both)] and not any("redis" in both[s:e] for s, e in secret_scan.candidates(both))
    keys = {1: "password: correcthorsebattery", 2: "passwd=hunter2", 3: url, 4: "DB_PASSWORD=Winter2024!", 5: "passphrase: 'lantern-copper-meadow'", 6: "https://bob:w0mbat77@git.example.org/x.git"}
    plain = {11: "password: required", 12: "password = getpass.getpass()", 13: "mysql://root:${DB_PASSWORD}@db/", 14: "https://user:password@example.com/", 15: "password: forgotten twice", 16: "pwd: /home/garden/river"}
    value = {1: "correcthorsebattery", 2: "hunter2", 3: "Sup3rS3cret99", 4: "Winter2024!", 5: "lantern-copper-meadow", 6: "w0mbat77"}
    around = {k: f"we set this here {t} and then went on" for k, t in (keys | plain).items()}
    found = secret_scan.scan(frame(spark, list(around.items())), forest).filter("secret").collect()
    tagged = {(r["doc_id"], r["value"]) for r in found}
    assert set(value.items()) <= tagged, sorted(set(value.items()) - tagged)
    assert not [r for r in tagged if r[0] > 10], tagged


def test_recall_of_the_values_in_documents(spark, forest):
    """Every value that ``documents`` assigns to a token is found whole, and no digest, card number or date that a pattern knows is taken."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r["doc_id"], m[1]) for r in docs.filter("text rlike '(?i)token = '").collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r["text"])}
    found = secret_scan.scan(docs, forest).filter("secret").collect()
    tagged = {(r["doc_id"], r["value"]) for r in found}
    assert len(want) >= 10 and want <= tagged
    assert len(tagged) <= 1.05 * len(want), sorted(tagged - want)[:10]


def test_rows_are_named_by_128_bits(spark):
    rows = [(None, "a"), ("a", None), (None, None), ("", ""), ("", None), (None, ""), ("1", "2:x"), ("1:2", "x"), ("12", ":x")]
    names = [r[0] for r in spark.createDataFrame(rows, "id string, text string").select(textkit.row_name("id", "text")).collect()]
    assert len({bytes(n) for n in names}) == len(rows) and all(len(n) == 16 for n in names)
    one = spark.createDataFrame([(7, "x"), (7, "x")], "id bigint, text string").select(textkit.row_name("id", "text").alias("n"))
    assert one.distinct().count() == 1


# 4: substring dedup


def test_repeated_passages_go(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(" ".join(["Word", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(7))]) + "." for _ in range(n))
    passage = prose(8)
    rows = [(1, prose(5) + " " + passage + " " + prose(4)), (2, prose(3) + " tail " + passage + "\n" + prose(2)), (3, prose(10)), (4, passage + " " + passage), (5, prose(9))]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, [*rows, *[(k + 10 if k else None, t) for k, t in ODD]])).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["n_removed"] == 0
    assert passage not in got[2]["text"] and got[2]["text"].startswith(rows[1][1][:60])
    assert got[3]["text"] == rows[2][1] and got[5]["text"] == rows[4][1]
    assert got[4]["text"].strip() == "" and got[4]["n_removed"] == got[4]["n_sentences"]
    assert got[12]["text"] in (None, "") and got[13]["text"] == ""
    assert substring_dedup.substring_dedup(frame(spark, ODD).limit(0)).count() == 0


def test_passages_pasted_mid_sentence_go(spark):
    rng = random.Random(44)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    for n in (50, 60):
        passage = prose(n)
        recased = " ".join(w.title() if k % 3 else w for k, w in enumerate(passage.split()))
        wrapped = "\n".join(" ".join(passage.split()[k : k + 7]) for k in range(0, n, 7))
        rows = [(k, f"{prose(40 + k)} {passage} {prose(30)}") for k in range(13)] + [(20, f"{prose(17)} {recased} {prose(9)}"), (21, f"{prose(8)} {wrapped} {prose(9)}"), (22, prose(200))]
        got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
        assert got[0]["n_removed"] == got[22]["n_removed"] == 0
        assert all(r["n_removed"] > 0 for k, r in got.items() if k not in (0, 22))
        for k, text in rows[1:-1]:
            gone = len(words(text)) - len(words(got[k]["text"]))
            assert 20 <= gone <= n, (k, gone)
            assert got[k]["text"].startswith(" ".join(text.split()[:8])) and got[k]["text"].endswith(text[-40:])


def test_spans_cover_every_run_of_sentences():
    rng = random.Random(45)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n)) + "."
    for _ in range(30):
        passage = " ".join(sentence(rng.randint(2, 14)) for _ in range(8))
        texts = [f"{sentence(5)} {passage} {sentence(9)}", f"{sentence(11)} {sentence(3)} {passage} {sentence(4)}"]
        (_, _, buf, off), *_ = textkit.text_chunks(pa.array(texts))
        h, row, place, size, _ = substring_dedup.spans(buf, off, 2, 20, substring_dedup.MAX_WORDS)
        shared = set(h[row == 0].tolist()) & set(h[row == 1].tolist())
        covered = {p + k for x, r, p, n in zip(h.tolist(), row, place, size, strict=True) if r == 0 and x in shared for k in range(n)}
        assert covered == set(range(5, 5 + len(passage.split())))


# 5: token counts


def test_counts_match_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.load_vocabulary()
    exact = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    ids = sorted(texts)
    assert [got[k] for k in ids] == [len(e.ids) for e in exact.encode_batch([texts[k] or "" for k in ids], add_special_tokens=False)]
    solver = token_counts.CountOnlyViterbi(vocabulary)
    odd = ["a  b", " a", "日本語 テスト", "\n\n x\t", "▁▁a", "a" * 3000, "é" * 50, "<s> hi <unk>", "<0x0A>x"]
    assert [solver.text(t) for t in odd] == [len(e.ids) for e in exact.encode_batch(odd, add_special_tokens=False)]
    got = token_counts.token_counts(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}


def test_ties_go_to_the_earlier_start():
    rng = random.Random(0)
    for _ in range(300):
        pieces = {"".join(rng.choices("ab", k=rng.randint(1, 3))) for _ in range(6)} | {"a", "b"}
        vocabulary = [("<unk>", 0.0), *[(p, float(-rng.randint(1, 3))) for p in sorted(pieces)]]
        from tokenizers import Tokenizer, models

        exact = Tokenizer(models.Unigram(vocabulary, unk_id=0))
        text = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        assert token_counts.CountOnlyViterbi(vocabulary).solve(text) == len(exact.encode(text).ids), (vocabulary, text)


# 6: sharding


def test_shards_are_even_and_keep_groups(spark):
    import zlib

    texts = similar_texts(2) * 2
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in sharding.shard(frame(spark, rows), shards=4, rounds=3).collect()}
    assert len(got) == len(rows)
    sizes = [sum(r["shard"] == k for r in got.values()) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(4):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == k) == list(range(sizes[k]))
    for k, t in rows:
        assert (got[k]["size"], got[k]["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", set()).add(got[k]["shard"])
    assert sum(len(s) > 1 for s in groups.values()) <= 3
    assert sharding.shard(frame(spark, ODD)).count() == len(ODD)
    assert sharding.shard(frame(spark, ODD).limit(0)).count() == 0


# 7: decontamination


def test_leaks_with_substitutions(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((30, 18, 40, 6))] + [(9, None), (10, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    swapped = items[0][1].split()
    for k in (4, 13, 22):
        swapped[k] = "other"
    rows = [
        (1, f"{filler(20)} {items[0][1]} {filler(9)}"),
        (2, f"{filler(3)}, {' '.join(swapped).upper()}! {filler(9)}"),
        (3, filler(200)),
        (4, f"{filler(5)} {' '.join(items[2][1].split()[10:30])} {items[1][1]}"),
        (5, f"{filler(5)} {items[3][1]} {filler(5)}"),
        (6, f"{filler(5)} {' '.join(items[2][1].split()[:8])} {filler(5)}"),
    ]
    docs, benchmark = frame(spark, [*rows, *[(k + 20 if k else None, t) for k, t in ODD]]), spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, benchmark).collect()}
    assert {k: r["items"] for k, r in got.items() if r["contaminated"]} == {1: [0], 2: [0], 4: [1, 2]}
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontamination.contamination(docs, benchmark.limit(0)).filter("contaminated").isEmpty()
    assert decontamination.contamination(docs.limit(0), benchmark).count() == 0


def test_short_items_leak(spark):
    rng = random.Random(77)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    filler = lambda n: " ".join(word() for _ in range(n))
    lengths = (1, 4, 5, 9, 10, 11, 14, 15)
    items = [(n, filler(n)) for n in lengths]
    rows, want = [], {}
    for n, text in items:
        w = text.split()
        forms = [(w, True)] + [([*w[:k], "other", *w[k + 1 :]], n >= 5) for k in range(n)]
        forms += [([*w[:2], "other", *w[3:-2], "other", w[-1]], False)] if n in (4, 5, 9, 10) else []
        for form, held in forms:
            want[len(rows)] = [n] if held else []
            rows.append((len(rows), f"{filler(7)} {' '.join(form)} {filler(6)}"))
        rows.append((len(rows), " ".join(w)))
        want[len(rows) - 1] = [n]
    docs, benchmark = frame(spark, rows), spark.createDataFrame([*items, (90, None), (91, "")], "item_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.contamination(docs, benchmark, min_words=1).collect()}
    assert got == want
    got = {r["doc_id"]: r["items"] for r in decontamination.contamination(docs, benchmark).collect()}
    assert got == {k: [n for n in v if n >= 10] for k, v in want.items()}


# 8: toxicity


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        first = np.array([0, *sorted(int(c) for c in rng.choice(n + 1, size=rng.integers(0, 3))), n])
        odds, model = np.exp(rng.normal(size=n)), {"transition": tuple(rng.uniform(0.1, 3, 4)), "start": 1.3}
        got = toxicity.marginals(odds, first, model)
        for s, e in zip(first[:-1], first[1:], strict=True):
            total, mass = 0.0, np.zeros(e - s)
            for path in itertools.product((0, 1), repeat=e - s):
                weight = 1.3 if path and path[0] else 1.0
                for i, y in enumerate(path):
                    weight *= odds[s + i] if y else 1.0
                    weight *= model["transition"][path[i - 1] * 2 + y] if i else 1.0
                total += weight
                mass += weight * np.array(path)
            assert np.allclose(mass / total, got[s:e])


def test_toxic_texts_are_found(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choices("lmnoprst", k=rng.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        text = rng.choices(plain, k=40)
        if toxic:
            for w in rng.choices(["vilebad", "vilegood", "zurko"], k=3):
                text.insert(rng.randrange(len(text)), w + rng.choice(["", ",", "."]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, marks)
    scored = toxicity.score(docs, model)
    found = {r["doc_id"]: r for r in scored.withColumn("out", toxicity.held_out("doc_id")).collect() if r["out"]}
    assert sum((found[k]["score"] >= 0.5) == (k % 4 == 0) for k in found) >= 0.95 * len(found)
    texts = dict(rows)
    tagged = [texts[k][int(a) : int(b)] for k in found for a, b in (p.split(":") for p in found[k]["toxic_spans"].split(",") if p)]
    assert tagged and sum(w.startswith(("vile", "zurko")) for w in tagged) >= 0.95 * len(tagged)
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] < 0.5 for r in odd)
    none = toxicity.train(docs, marks.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(docs, none).collect()} == {0.0}


# 9: packing


def test_bounds_are_optimal():
    rng = random.Random(9)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 7))
        histogram, k = [(n, rng.randint(1, 9)) for n in lengths], rng.randint(1, 4)
        padding = lambda bounds: sum((min(b for b in bounds if b >= n) - n) * c for n, c in histogram)  # noqa: E731, B023
        best = min(padding([*c, max(lengths)]) for r in range(min(k, len(lengths))) for c in itertools.combinations(sorted(lengths)[:-1], r))
        bounds = packing.optimal_bounds(histogram, k)
        assert padding(bounds) == best and len(bounds) <= k


def test_batches_hold_their_budget(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.choice([0, 3, 10, 50, 300]))) for k in range(200)]
    got = packing.pack_documents(frame(spark, [*rows, *ODD]), budget=400, buckets=3).collect()
    assert len(got) == len(rows) + len(ODD)
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len({r["bucket_len"] for r in b}) == 1
        assert len(b) * b[0]["bucket_len"] <= max(400, b[0]["bucket_len"])
        assert all(r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in b)
    assert packing.pack_documents(frame(spark, ODD).limit(0)).count() == 0


# 10: personal data


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans(spark):
    texts = [
        "a@b.c_d@e.f x@y.zz..@q.w.e", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.256 001.002.003.004", "4111 1111 1111 1111x 4111-1111-1111-1111", "+1 (499) 555-6503 +12 +1-2-3-4-5-6-7-8-9",
        "é@a.b ü a%b@c-d.e-f. 日本a@b.co", "1" * 30_000, "a" * 30_000 + "@", "+1" + " (" * 500 + "9", "", None, "a@b.c" * 3, "000000000000 0000000000001.1.1.1", "\U0001f600 1.2.3.4",
    ]
    rng = random.Random(10)
    texts += ["".join(rng.choices("ab@.+ 19-()%_4", k=60)) for _ in range(200)]
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["b"] for r in pii.private_spans(docs).select("doc_id", pii.span_list(pii.F.col("base")).alias("b")).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_disclosing_terms(spark):
    rows = [(k, f"please ask agent zorblat 10.0.0.1 of the {w}") for k, w in enumerate(["north", "south", "east"])]
    rows += [(k, f"please ask agent {w} of the north of the south of the east") for k, w in enumerate(["one", "two", "six"], 10)]
    docs = frame(spark, rows)
    terms = {r["doc_id"]: [x["v"] for x in r["terms"]] for r in pii.private_spans(docs).collect()}
    assert terms[0] == terms[1] == terms[2] == ["zorblat"] and not terms[10]
    clean = pii.sanitise(docs)
    assert clean.columns == [*docs.columns, "n_spans"]
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[0] == "please ask agent [WORD] [IP] of the north"
    assert pii.sanitise(frame(spark, ODD)).count() == len(ODD)
    assert pii.private_spans(frame(spark, ODD).limit(0)).count() == 0


def test_base_digest(spark, sf_dir):
    from arcwave.llm.registry import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op10_pii"](spark, sf_dir).collect():
        assert r["base_sha256"] == hashlib.sha256(base(texts[r["doc_id"]]).encode()).hexdigest()
