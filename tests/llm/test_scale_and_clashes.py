"""Clashing columns, long texts, crowded groups, and operators against brute force."""

import itertools
import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest

from arcwave.llm import decontamination, embedding_dedup, ngram_join, packing, pii, secret_scan, sharding, substring_dedup, token_counts, toxicity

from test_text_operators import components, similar_texts

CLASHES = ("__key", "__spans", "key", "spans", "clean", "score", "n_toxic", "toxic_spans", "text_key", "h", "id", "n", "Key_")
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def clashing(spark, rows):
    names = ", ".join(f"`{c}` {'double' if c == 'score' else 'string'}" for c in CLASHES)
    return spark.createDataFrame([(k, t, *[7.0 if c == "score" else f"own {c}" for c in CLASHES]) for k, t in rows], f"doc_id bigint, text string, {names}")


def own_columns_stay(df):
    return all(r[c] == (7.0 if c == "score" else f"own {c}") for r in df.collect() for c in CLASHES)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def test_clashing_columns_stay(spark, words, tmp_path):
    bad = [words(20) + " vilebad zurko " + words(10) for _ in range(40)]
    good = [words(40) for _ in range(120)]
    item = words(30)
    rows = [(k, t) for k, t in enumerate([*bad, *good, good[0], f"{words(5)} {item} {words(5)}", f'{words(5)} token = "{KEY}" {words(5)}'])] + [(None, None), (900, ""), (None, "one two")]
    docs = clashing(spark, rows)
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(160)], "doc_id bigint, toxic int")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        counts.append(docs.count())
        assert docs.columns == ["doc_id", "text", *CLASHES] and own_columns_stay(docs), name
    assert counts == [126, 125, 124, 124]
    kept = docs.collect()
    assert sum("[SECRET]" in (r["text"] or "") for r in kept) == 1 and sum(r["doc_id"] is None for r in kept) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 124
    assert pii.sanitise(docs).columns == [*docs.columns, "n_spans"] and own_columns_stay(pii.sanitise(docs))
    for run in (substring_dedup.substring_dedup, token_counts.token_counts, sharding.shard, packing.pack_documents):
        assert run(docs).count() == 124


def test_stages_on_empty_tables(spark, tmp_path):
    docs = clashing(spark, [(1, "some words")])
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 1, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


# 1: a line that most texts hold


def test_boilerplate_brings_nothing_together(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 20)
    rng = random.Random(1)  # its own: a token that few prefixes reach may stay in its place, so sizes differ by the words drawn
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    line = words(9)
    texts = [f"{words(8)} {line} {words(7)}" for _ in range(150)]
    texts += [t + " more" for t in texts[:10]] + [line, line + " x", f"{line} {line} {words(1)}", f"{line} {line} {words(1)}"] + [f"{words(4)} {words(130)}" for _ in range(3)]
    texts += [f"{line} {words(150)}" for _ in range(30)]
    texts += [texts[-1] + " end", texts[-40] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for exact in (False, True):
        found = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(docs, exact=exact).collect()}
        assert found == dict(enumerate(components(texts)))
    reps = ngram_join.sketches(docs, 5, "doc_id", "text").selectExpr("key as node", "n", "toks", "want", "capped")
    sizes = sorted((r["count"] for r in ngram_join._posted(reps).filter("not capped").groupBy("tok").count().collect()), reverse=True)
    assert sizes[0] < 60  # 180 texts hold each token of the line


def test_random_texts_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "HOT", 4)
    texts = similar_texts(11)
    found = ngram_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(components(texts)))


# 2: comparisons


def test_comparisons_grow_with_the_vectors():
    rng = np.random.default_rng(2)
    work = []
    for n in (10_000, 80_000):
        x = rng.normal(size=(n, 16))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        m = embedding_dedup.pivot_count(n)
        pivots = unit[rng.permutation(n)[:m]]
        perm = np.concatenate([np.sort(np.argpartition(-(unit[k : k + 5000] @ pivots.T), 8, axis=1)[:, :8], axis=1) for k in range(0, n, 5000)])
        keys = np.concatenate([perm[:, i] * m + perm[:, j] for i, j in itertools.combinations(range(8), 2)])
        c = np.unique(keys, return_counts=True)[1].astype(float)
        work.append((c * (c - 1) / 2).sum())
    assert work[1] / work[0] < 2 * 8


def test_cosines_at_the_threshold(spark, monkeypatch):
    """Integer vectors, many of them with a cosine of exactly 0.9: links are those of dot / (norm * norm) in doubles."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = random.Random(9)
    vectors = {(10, 0, 0, 0), (9, 3, 3, 1), (1, 0, 0, 0), (0, 10, 0, 0), (3, 9, 1, 3)}
    for x in itertools.product(range(-9, 10), repeat=3):  # (9, x) and (10, 0, 0, 0) have 9 / 10 if the squares of x sum to 19
        if sum(c * c for c in x) == 19:
            vectors.add((9, *x))
    while len(vectors) < 150:
        vectors.add(tuple(rng.randrange(-6, 10) for _ in range(4)))
    held = [v for v in sorted(vectors) if any(v)]
    norm = [math.sqrt(sum(c * c for c in v)) for v in held]
    linked = lambda i, j: i != j and sum(a * b for a, b in zip(held[i], held[j], strict=True)) / (norm[i] * norm[j]) >= 0.9
    want = {i: sum(linked(i, j) for j in range(len(held))) for i in range(len(held))}
    ties = [(i, j) for i in range(len(held)) for j in range(len(held)) if 100 * sum(a * b for a, b in zip(held[i], held[j], strict=True)) ** 2 == 81 * sum(c * c for c in held[i]) * sum(c * c for c in held[j]) and linked(i, j)]
    assert len(ties) > 20
    rows = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(held)], "vec_id bigint, embedding array<double>")
    # four axes are few: every pivot describes every vector, so recall is not in play
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(rows, prefix=12).collect()}
    assert got == want
    scaled = embedding_dedup.near_pairs(embedding_dedup._scaled(np.array(held) * 1e300), embedding_dedup._scaled(np.array(held) * 1e-300), 0.9)
    assert all(scaled[i, j] == linked(i, j) for i in range(len(held)) for j in range(len(held)) if i != j)


def test_crowded_lists_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(12, 8)), 12, axis=0) + 0.05 * rng.normal(size=(144, 8))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200 + k, [1.0, 2.0 + k / 9, 3.0]) for k in range(5)], "vec_id bigint, embedding array<double>")
    rows = lambda: {tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()}
    whole = rows()
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    assert rows() == whole
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.9).sum()) - 144
    found = {r[0]: r[1] for r in whole}
    assert 0.9 * links <= sum(found[k] for k in range(144)) <= links
    assert sum(found[200 + k] for k in range(5)) == 20


# 3: findings of shapes that the forest has not seen, and keys and decoys in documents


def test_unseen_shapes(spark):
    from pyspark.ml.functions import array_to_vector

    out = ["deploy token", "signed token", "uuid", "number", "date", "order id"]
    columns = "before string, value string, after string, path string, label int"
    model = secret_scan.train(spark, spark.createDataFrame(secret_scan.labelled_findings(3000, 3, [k for k in secret_scan.SHAPES if k not in out]), columns))
    describe = secret_scan.Describer().features
    rows = [(describe(*r[:4]), float(r[4])) for r in secret_scan.labelled_findings(600, 5, out)]
    frame = spark.createDataFrame(rows, "x array<double>, label double").withColumn("features", array_to_vector("x"))
    right = {r["label"]: r["n"] for r in model.transform(frame).filter("prediction = label").groupBy("label").agg(secret_scan.F.count("*").alias("n")).collect()}
    assert right[1.0] >= 0.8 * 300 and right[0.0] >= 0.95 * 300


def test_planted_keys_and_decoys(spark, sf_dir):
    rng = random.Random(31)
    prose = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) between 200 and 4000").orderBy("doc_id").limit(120).collect()]
    rows, keys, decoys = [], {}, {}
    for k, text in enumerate(prose):
        words = text.split(" ")
        key = rng.choice([f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}"', f"API_KEY={''.join(rng.choices(secret_scan._ALNUM, k=36))}", f"password: '{''.join(rng.choices(secret_scan._ALNUM, k=16))}'"])
        decoy = rng.choice(["".join(rng.choices("0123456789", k=16)), secret_scan._uuid(rng), "sha1 " + "".join(rng.choices("0123456789abcdef", k=40)), secret_scan._date(rng), "report2024-final"])
        place = len(words) // 2
        rows.append((k, " ".join([*words[:place], key, *words[place:], decoy])))
        keys[k] = re.split(r"[=:] ?['\"]?", key)[-1].rstrip("'\"")
        decoys[k] = decoy.split(" ")[-1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = secret_scan.scan(docs, secret_scan.train(spark)).collect()
    assert any(not r["secret"] for r in found)
    tagged = {(r["doc_id"], r["value"]) for r in found if r["secret"]}
    assert sum((k, v) in tagged for k, v in keys.items()) >= 0.95 * len(keys)
    assert sum((k, v) in tagged for k, v in decoys.items()) <= 0.05 * len(decoys)


# 4: long sentences, against runs of equal words


def test_spans_of_many_sentences(spark, words):
    passage = ". ".join(words(1) for _ in range(700)) + "."
    rows = [(1, f"{words(50)} {passage} {words(40)}"), (2, f"{words(30)} {passage} {words(50)}"), (3, words(400))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, min_words=300, max_words=1).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["n_removed"] == 0
    assert 690 <= len(rows[1][1].split()) - len(got[2]["text"].split()) <= 700 and got[2]["text"].startswith(rows[1][1][:100])
    with pytest.raises(ValueError):
        substring_dedup.repeated_sentences(docs, min_words=1 << 24)


def test_removed_words_stand_in_another_place(spark):
    rng = random.Random(41)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    passages = [rng.choices(vocabulary, k=rng.randint(30, 90)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choices(vocabulary, k=rng.randint(5, 60)) for _ in range(2)]
        texts.append([*parts[0], *(rng.choice(passages) if rng.random() < 0.5 else []), *parts[1]])
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")).collect()}
    earlier: dict[tuple, int] = {}
    for k, t in enumerate(texts):  # words in runs of 20 that a text before holds
        covered = [False] * len(t)
        for i in range(len(t) - 19):
            if earlier.get(tuple(t[i : i + 20]), k) < k:
                covered[i : i + 20] = [True] * 20
        for i in range(len(t) - 19):
            earlier.setdefault(tuple(t[i : i + 20]), k)
        gone = len(t) - len(got[k]["text"].split())
        assert gone <= sum(covered) and (sum(covered) < 50 or gone >= 20)


# 6: links


def test_propagation_keeps_links_together(spark):
    rng = random.Random(6)
    base = [" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(40)) for _ in range(60)]
    texts = [" ".join(b.split()[rng.randrange(8) :]) + f" tail{k}" for k, b in enumerate(base * 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sharding.described(docs).selectExpr("id", "explode(toks) as tok")

    def cut(rounds):
        placed = sharding.shard(docs, shards=4, rounds=rounds).selectExpr("doc_id as id", "shard")
        by = {}
        for r in rows.join(placed, "id").collect():
            by.setdefault(r["tok"], []).append(r["shard"])
        pairs = [(a, b) for s in by.values() for a, b in itertools.combinations(s, 2)]
        return sum(a != b for a, b in pairs) / len(pairs)

    at_last = cut(4)
    assert at_last < 0.1 < 0.75  # 0.75 by chance
    assert at_last <= cut(0)


def test_propagation_brings_links_together(spark):
    """Rings of groups in which neighbours share tokens but no token is shared by most, so homes differ inside a ring: labels must move."""
    rng = random.Random(3)
    rings, size = 30, 20
    token = [[rng.randrange(1 << 60) for _ in range(size)] for _ in range(rings)]
    rows = [(1000 * r + i, 1, [token[r][(i + k) % size] for k in range(4)]) for r in range(rings) for i in range(size)]
    groups = spark.createDataFrame(rows, "g bigint, w bigint, toks array<bigint>")

    def cut(rounds):
        label = {r["g"]: r["label"] for r in sharding.propagate(groups, 4, rounds).collect()}
        assert len(label) == len(rows)
        pairs = [(1000 * r + i, 1000 * r + (i + d) % size) for r in range(rings) for i in range(size) for d in (1, 2, 3)]
        return sum(label[a] != label[b] for a, b in pairs) / len(pairs)

    before, after = cut(0), cut(8)
    assert before > 0.5 and after < 0.75 * before, (before, after)


# 7: every alignment over the bound


def test_alignments_against_brute_force(spark, words):
    rng = random.Random(71)
    items = [words(rng.randint(12, 40)).split() for _ in range(25)]
    texts = []
    for _ in range(200):
        item, rate = rng.choice(items), rng.choice([0.05, 0.15, 0.25, 0.35])
        start = rng.randrange(len(item) // 2)
        part = [w if rng.random() > rate else "other" for w in item[start : rng.randint(start + 6, len(item))]]
        texts.append([*words(rng.randint(0, 9)).split(), *part, *words(rng.randint(0, 9)).split()])

    def held(text, item):
        for shift in range(-len(item), len(text)):
            same = [0 <= j + shift < len(text) and text[j + shift] == w for j, w in enumerate(item)]
            run = best = 0
            for s in same:
                run = max(0, run + (1 if s else -2))
                best = max(best, run)
            if best >= min(12, math.ceil(0.8 * len(item))) or sum(same) >= len(item) - 1:
                return True
        return False

    want = {k: [i for i, item in enumerate(items) if held(t, item)] for k, t in enumerate(texts)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.contamination(docs, benchmark).collect()}
    pairs = lambda x: {(k, i) for k, v in x.items() for i in v}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.99 * len(pairs(want)) > 30


# 8: the chain's gradient


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(8)
    n, k = 7, 3
    first = np.array([0, 3, 3, 7])
    label = rng.random(n) < 0.4
    word, form = np.array([0, 1, 1, 3, 4, 6]), np.array([0, 1, 2, 0, 2, 1])
    theta = rng.normal(size=k + 5) * 0.5

    def parts(t):
        score = t[k] + np.bincount(word, weights=t[form], minlength=n)
        return score, {"start": float(np.exp(t[k + 1])), "transition": (1.0, *np.exp(t[k + 2 :]))}

    def likelihood(t):
        score, model = parts(t)
        log_t, total = np.log(model["transition"]), 0.0
        for s, e in zip(first[:-1], first[1:], strict=True):
            if s == e:
                continue
            weight = lambda path: sum(score[s + i] * y + (log_t[path[i - 1] * 2 + y] if i else t[k + 1] * y) for i, y in enumerate(path))  # noqa: E731, B023
            paths = [weight(p) for p in itertools.product((0, 1), repeat=int(e - s))]
            total += weight(label[s:e].astype(int).tolist()) - np.logaddexp.reduce(paths)
        return total

    score, model = parts(theta)
    got = toxicity.gradient(label, word, form, k, np.exp(score), first, model)
    for i in range(k + 5):
        step = np.zeros(k + 5)
        step[i] = 1e-5
        assert abs((likelihood(theta + step) - likelihood(theta - step)) / 2e-5 - got[i]) < 1e-6


def test_logistic_reaches_its_optimum():
    rng = np.random.default_rng(9)
    x = np.concatenate([np.ones((500, 1)), rng.normal(size=(500, 2)) * [1, 30]], 1)
    y = rng.random(500) < 1 / (1 + np.exp(-(x @ [0.3, 2.0, 0.4])))
    beta = toxicity.fit_logistic(x, y, np.ones(500))
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - 1e-2 * beta
    assert np.abs(slope).max() < 1e-4


# 10: co-occurrence, and many spans


def test_terms_against_brute_force(spark):
    rng = random.Random(101)
    common = [f"c{k}" for k in range(30)]
    people = [(f"p{k}@mail.org", [f"name{k}", f"street{k}"]) for k in range(6)]
    texts = []
    for _ in range(150):
        body = rng.choices(common, k=12)
        if rng.random() < 0.4:
            mail, secret = rng.choice(people)
            body += [mail] + [s for s in secret if rng.random() < 0.7]
        if rng.random() < 0.1:
            body.append(rng.choice(rng.choice(people)[1]))
        rng.shuffle(body)
        texts.append(" ".join(body))
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: {(x["s"], x["e"], x["v"]) for x in r["terms"]} for r in pii.private_spans(docs).collect()}
    n = len(texts)
    sets = [set(w for w in re.split(r"[^\w]+", t) if len(w) > 1) for t in texts]
    mails = [set(re.findall(r"p\d@mail\.org", t)) for t in texts]
    telling = set()
    for e in {m for x in mails for m in x}:
        c_e = sum(e in m for m in mails)
        for t in {w for s, m in zip(sets, mails, strict=True) if e in m for w in s}:
            both = [k for k in range(n) if e in mails[k] and t in sets[k]]
            c_t = sum(t in s for s in sets)
            if len({texts[k] for k in both}) >= 2 and math.log2(n * len(both) / (c_t * c_e)) >= 0.9 * math.log2(n / c_e) - 1e-9:
                telling.add((e, t))
    assert telling
    for k, t in enumerate(texts):
        base = [m.span() for m in re.finditer(r"p\d@mail\.org", t)]
        want = {(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", t) if any((e, m[0]) in telling for e in mails[k]) and not any(m.start() < b and m.end() > a for a, b in base)}
        assert got[k] == want


def test_many_spans_in_one_text(spark):
    text = "é " + " ".join(f"word{k} {k % 256}.{k // 256 % 256}.0.7" for k in range(20_000)) + " end"
    docs = spark.createDataFrame([(1, text), (2, text + " again"), (3, "plain words")], "doc_id bigint, text string")
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert clean[1]["n_spans"] == 40_001 and clean[3]["n_spans"] == 0  # and the last word
    assert clean[1]["text"] == "é " + "[WORD] [IP] " * 20_000 + "[WORD]" and clean[3]["text"] == "plain words"


def _spans(docs, **more):
    return {r["doc_id"]: [tuple(x) for x in r["terms"]] for r in pii.private_spans(docs, **more).collect()}


@pytest.mark.parametrize(("support", "bound"), [(1, 0), (2, 30), (3, 0)])
def test_heavy_texts_change_nothing(spark, monkeypatch, support, bound):
    """Texts of many people and terms, some in several texts; listed as pairs, in part, and by look-up alone."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        who = rng.sample(range(25), rng.choice([1, 1, 2, 3, 12]))
        body = [f"p{k}@mail.org" for k in who] + [f"name{k}" for k in who if rng.random() < 0.8] + rng.choices([f"c{k}" for k in range(40)], k=5)
        rng.shuffle(body)
        texts.append(" ".join(body))
    docs = spark.createDataFrame(list(enumerate(texts + texts[:6])), "doc_id bigint, text string")
    want = _spans(docs, support=support)
    assert any(want.values())
    monkeypatch.setattr(pii, "HEAVY", bound)
    monkeypatch.setattr(pii, "HEAVY_ROWS", 3)
    assert _spans(docs, support=support) == want


def test_directory_of_many_people(spark):
    """One text names all of 3,000 people that have a text each: nine million pairs in it, three thousand that another text holds."""
    n = 3_000
    rows = [(k, f"write to u{k}@mail.org about zon{k}") for k in range(n)] + [(n, " ".join(f"u{k}@mail.org zon{k}" for k in range(n)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {k: [x[3] for x in v] for k, v in _spans(docs).items()}
    assert all(got[k] == [f"zon{k}"] for k in range(n)) and got[n] == [f"zon{k}" for k in range(n)]
