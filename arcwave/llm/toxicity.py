"""Toxicity by a linear-chain conditional random field over words.

Training takes at most ``TRAIN_PER_CLASS`` labelled texts of each class, those of the smallest hashes
of doc_id among rows that are not held out. A word of a toxic text counts as a toxic token if one
of its forms (the word, or its first or last letters) is tied to toxic texts by a likelihood-ratio
test (token labels are derived from text labels in this way, as no table has them). The chain (form weights,
transitions, start, bias) is then fitted to these token labels by gradient steps on its penalised log-likelihood: observed
less expected counts of forms, of label pairs and of first labels, which forward-backward gives. The marginal of each word
tags toxic spans; a text's score is a logistic function of
what its marginals sum to and its largest, fitted to the labels of texts that the chain has not seen, with weights that restore
the classes' shares.

Labels, language, source and ids are never inputs of a score. Null and empty texts have no words and
get the score of a text without toxic words. Null ids are not held out and are never trained on;
repeated label rows count once, as toxic if any says so; of rows that repeat an id the smallest text trains. Without labels
of both classes all scores are 0. An empty table gives no rows. A tie (score 0.5, or a marginal of 0.5) counts as toxic.
Texts of any length are scored whole. The columns of the result must have names that the table lacks (``names``): columns
of the same names are replaced.
Memory: 1 MB of text (or one longer text) at a time in a task. One task trains; it holds the sample, which is bounded in rows and in bytes:
texts of over ``TRAIN_BYTES`` bytes are not trained on (they are scored like all others). The driver gets the model alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwave.plans.names import free
from arcwave.llm.textkit import BASE, LOWER, U64, mix, powers, slices, text_chunks, word_spans, word_starts

TRAIN_PER_CLASS = 1500
TRAIN_BYTES = 20_000
MAX_FORMS = 4096
MIN_TEXTS = 3
TIED = 15.0  # likelihood ratio of a form that makes a token toxic
USEFUL = 8.0  # and of one that gets a weight
PREFIXES, SUFFIXES = (4, 5, 6), (4, 5)
STEPS = 40
HELD = 4  # one in so many texts of the sample fits the text model, not the chain
_SLOT_BITS = 22
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def words_and_forms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Byte starts and ends of the words without outer punctuation, each text's first word, and one hash array for each kind of form (0: none)."""
    starts, ends, first = word_spans(buf, off)
    n = len(starts)
    if not n:
        return starts, ends, first, [np.zeros(0, np.uint64)] * (1 + len(PREFIXES) + len(SUFFIXES))
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        starts += _PUNCTUATION[buf[starts]] & (ends - starts > 1)
        ends -= _PUNCTUATION[buf[ends - 1]] & (ends - starts > 1)
    size = ends - starts
    longest = int(size.max()) + 1
    place = np.minimum(np.arange(len(buf)) - word_starts(len(buf), starts), longest)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[buf] + 1).astype(np.uint64) * powers(longest + 1)[place])])
    back = np.ones(longest + 1, np.uint64)
    back[1:] = _INVERSE
    back = np.multiply.accumulate(back)
    forms = [mix(sums[ends] - sums[starts])]
    for k in PREFIXES:
        forms.append(np.where(size >= k, mix(sums[np.minimum(starts + k, ends)] - sums[starts] + U64(k)), U64(0)))
    for k in SUFFIXES:
        skip = np.maximum(size - k, 0)
        forms.append(np.where(size >= k, mix((sums[ends] - sums[starts + skip]) * back[skip] + U64(100 + k)), U64(0)))
    return starts, ends, first, forms


def ratios(odds: np.ndarray, first: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """alpha(1) / alpha(0) and beta(1) / beta(0) of each word. ``odds``: potentials of state 1 against 0; ``first``: each text's first word.

    All texts form one chain that restarts at each text. It is cut into rows that run side by side: their
    2x2 products give the ratio at each row's start, and a second sweep fills the rows.
    """
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros(0)
    t00, t01, t10, t11 = model["transition"]
    heads = np.zeros(n, bool)
    heads[first[:-1][np.diff(first) > 0]] = True
    tails = np.append(heads[1:], True)
    width = max(1, int(2 * n**0.5))
    rows = -(-n // width)
    pad = rows * width - n
    grid = lambda x, fill: np.ascontiguousarray(np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(rows, width).T)
    e, head, tail = grid(odds, 1.0), grid(heads, True), grid(tails, True)

    def sweep(steps: range, matrix: object) -> np.ndarray:
        """Ratios after each step of x -> (c + d x) / (a + b x)."""
        a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for k in steps:
            p, q, r, s = matrix(k)
            a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
        x, start = 1.0, np.ones(rows)
        order = range(rows) if steps.step > 0 else range(rows - 1, -1, -1)
        for i, ai, bi, ci, di in zip(order, a[:: steps.step].tolist(), b[:: steps.step].tolist(), c[:: steps.step].tolist(), d[:: steps.step].tolist(), strict=True):
            start[i] = x
            x = min((ci + di * x) / max(ai + bi * x, 1e-300), 1e300)
        out, x = np.empty((width, rows)), start
        for k in steps:
            p, q, r, s = matrix(k)
            x = (r + s * x) / (p + q * x)
            out[k] = x
        return out

    begin = model["start"]
    # forward: alpha1/alpha0; backward: beta1/beta0, which is 1 behind a text's last word
    forward = sweep(range(width), lambda k: (np.where(head[k], 1.0, t00), np.where(head[k], 0.0, t10), e[k] * np.where(head[k], begin, t01), e[k] * np.where(head[k], 0.0, t11)))
    nxt = np.empty_like(e)
    nxt[:-1] = e[1:]
    nxt[-1] = np.append(e[0][1:], 1.0)
    backward = sweep(range(width - 1, -1, -1), lambda k: (np.where(tail[k], 1.0, t00), np.where(tail[k], 0.0, t01 * nxt[k]), np.where(tail[k], 1.0, t10), np.where(tail[k], 0.0, t11 * nxt[k])))
    flat = lambda x: x.T.reshape(-1)[:n]
    return flat(forward), flat(backward)


def marginals(odds: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """P(toxic) of each word by forward-backward."""
    forward, backward = ratios(odds, first, model)
    joint = forward * backward
    return joint / (1.0 + joint)


def expected(odds: np.ndarray, first: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """P(toxic) of each word, the expected numbers of the label pairs 00, 01, 10, 11, and of toxic first words."""
    forward, backward = ratios(odds, first, model)
    joint = forward * backward
    p = joint / (1.0 + joint)
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(odds), bool)
    inner[heads] = False
    k = np.flatnonzero(inner)
    t00, t01, t10, t11 = model["transition"]
    into = odds[k] * backward[k]
    mass = np.stack([np.full(len(k), t00), t01 * into, t10 * forward[k - 1], t11 * forward[k - 1] * into])
    return p, (mass / mass.sum(axis=0)).sum(axis=1), float(p[heads].sum())


def gradient(label: np.ndarray, word: np.ndarray, form: np.ndarray, forms: int, odds: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    """Of the chain's log-likelihood: by form weights, bias, start, and the logs of the transitions 01, 10, 11."""
    p, pairs, start = expected(odds, first, model)
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(label), bool)
    inner[heads] = False
    seen = np.bincount((label[:-1] * 2 + label[1:])[inner[1:]], minlength=4)
    gap = label - p
    return np.concatenate([np.bincount(form, weights=gap[word], minlength=forms), [gap.sum(), label[heads].sum() - start], (seen - pairs)[1:]])


def slots(keys: np.ndarray, seed: int) -> np.ndarray:
    return ((keys * U64(seed)) >> U64(64 - _SLOT_BITS)).astype(np.int64)


def slot_table(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """A multiplier and a table that send each key to its own place: place + 1 of the key, else 0."""
    for k in range(1, 10_000):
        seed = int(mix(np.array([k], np.uint64))[0]) | 1
        at = slots(keys, seed)
        if len(np.unique(at)) == len(keys):
            table = np.zeros(1 << _SLOT_BITS, np.int16)
            table[at] = np.arange(1, len(keys) + 1)
            return seed, table
    raise RuntimeError("no collision-free table")


def active(forms: list[np.ndarray], keys: np.ndarray, seed: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, form) places of all forms that are among the keys."""
    words, found = [], []
    for h in forms:
        at = table[slots(h, seed)].astype(np.int64) - 1
        hit = np.flatnonzero(at >= 0)
        hit = hit[keys[at[hit]] == h[hit]]
        words.append(hit)
        found.append(at[hit])
    return np.concatenate(words), np.concatenate(found)


def _features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text: log(1 + expected toxic words), the largest log-odds of a word, and that expectation by the root of the length."""
    n = len(first) - 1
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    total = np.bincount(row, weights=np.where(p > 0.01, p, 0.0), minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, p)
    top = np.clip(top, 1e-5, 1 - 1e-5)
    return np.stack([np.ones(n), np.log1p(total), np.log(top / (1 - top)), total / np.sqrt(np.maximum(count, 1))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps, halved until the penalised log-likelihood rises."""
    value = lambda b: (weights * (y * (x @ b) - np.logaddexp(0, x @ b))).sum() - ridge / 2 * (b @ b)
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (weights * (y - q)) - ridge * beta
        bend = (x * (weights * np.maximum(q * (1 - q), 1e-9))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(bend, slope)
        while np.abs(move).max() > 1e-9 and value(beta + move) < value(beta):
            move = move / 2
        beta = beta + move
        if np.abs(move).max() < 1e-7:
            break
    return beta


def fit_chain(texts: pa.ChunkedArray, toxic: np.ndarray) -> dict:
    """The chain from labelled texts; without texts of both classes, or forms tied to either, one that knows no form."""
    if not len(texts) or toxic.all() or not toxic.any():
        return {"keys": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": -20.0, "transition": (1.0, 1.0, 1.0, 1.0), "start": 1.0}
    chunks = [words_and_forms(buf, off) for _, _, buf, off in text_chunks(texts)]
    forms = [np.concatenate([c[3][k] for c in chunks]) for k in range(1 + len(PREFIXES) + len(SUFFIXES))]
    counts = np.concatenate([np.diff(c[2]) for c in chunks])
    del chunks
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(texts)), counts)
    # texts of each class that hold a form
    keys, hits = [], []
    for h in forms:
        at = np.flatnonzero(h)
        at = at[np.unique(mix(h[at] + doc[at].astype(np.uint64) * BASE), return_index=True)[1]]  # one of each form and text
        k, inverse = np.unique(h[at], return_inverse=True)
        y = toxic[doc[at]]
        keys.append(k)
        hits.append(np.stack([np.bincount(inverse, weights=y, minlength=len(k)), np.bincount(inverse, weights=~y, minlength=len(k))], 1))
    keys, hits = np.concatenate(keys), np.concatenate(hits)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    a, b = hits[:, 0], hits[:, 1]
    term = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / expected), 0.0)
    rate = (a + b) / (n1 + n0)
    ratio = 2 * (term(a, n1 * rate) + term(b, n0 * rate) + term(n1 - a, n1 * (1 - rate) + 1e-9) + term(n0 - b, n0 * (1 - rate) + 1e-9))
    up = (a + 0.5) / (n1 + 1) > 6 * (b + 0.5) / (n0 + 1)
    useful = np.flatnonzero((a + b >= MIN_TEXTS) & (ratio >= USEFUL))
    useful = useful[np.lexsort((keys[useful], -ratio[useful]))][:MAX_FORMS]
    keys, tied = keys[useful], (up & (ratio >= TIED))[useful]
    keys, unique = np.unique(keys, return_index=True)
    tied = tied[unique]
    seed, table = slot_table(keys)
    word, form = active(forms, keys, seed, table)
    label = np.zeros(len(doc), bool)
    label[word[tied[form]]] = True
    label &= toxic[doc]
    # the chain: gradient steps (Adam) on the token log-likelihood, with an L2 prior
    size = len(keys)
    theta = np.zeros(size + 5)  # form weights, bias, start, log transitions 01, 10, 11
    theta[size] = np.log((label.sum() + 1.0) / (len(label) + 2.0))
    support = np.maximum(np.bincount(form, minlength=size), 1.0)
    toxic_words = max(int(label.sum()), 1)
    scale = np.concatenate([support, np.full(5, toxic_words)])
    prior = np.concatenate([np.full(size, 0.1), [0.0], np.full(4, 1.0)])
    m1, m2 = np.zeros(size + 5), np.zeros(size + 5)
    unpacked = lambda: {"keys": keys, "weights": theta[:size], "bias": float(theta[size]), "start": float(np.exp(theta[size + 1])), "transition": (1.0, *np.exp(theta[size + 2 :]).tolist())}
    for step in range(1, STEPS + 1):
        score = theta[size] + np.bincount(word, weights=theta[form], minlength=len(doc))
        grad = (gradient(label, word, form, size, np.exp(np.clip(score, -40, 40)), first, unpacked()) - prior * theta) / scale
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        theta[size + 1 :] = np.clip(theta[size + 1 :], -8, 8)
    model = unpacked()
    return model


def fit(texts: pa.ChunkedArray, toxic: np.ndarray, weights: np.ndarray) -> dict:
    """The chain from ``1 - 1 / HELD`` of the labelled texts, and the text model from the others, whose words it has not seen; ``weights`` restore the classes' shares."""
    toxic = np.asarray(toxic, bool)
    held = np.zeros(len(toxic), bool)
    for y in (False, True):
        held[np.flatnonzero(toxic == y)[HELD - 1 :: HELD]] = True
    if not toxic[held].any() or toxic[held].all():
        held[:] = False
    model = fit_chain(texts.filter(pa.array(~held)), toxic[~held])
    if not len(model["keys"]):
        return model | {"text": (-50.0, 0.0, 0.0, 0.0)}
    use = held if held.any() else ~held
    seed, table = slot_table(model["keys"])
    x = []
    for _, _, buf, off in text_chunks(texts.filter(pa.array(use))):
        _, _, first, forms = words_and_forms(buf, off)
        x.append(_features(score_words(forms, first, model, seed, table), first))
    return model | {"text": tuple(fit_logistic(np.concatenate(x), toxic[use], weights[use]).tolist())}


def score_words(forms: list[np.ndarray], first: np.ndarray, model: dict, seed: int, table: np.ndarray) -> np.ndarray:
    score = np.full(int(first[-1]), model["bias"])
    if len(model["keys"]):
        word, form = active(forms, model["keys"], seed, table)
        score += np.bincount(word, weights=model["weights"][form], minlength=len(score))
    return marginals(np.exp(np.clip(score, -40, 40)), first, model)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES) -> dict:
    """A model from the labelled rows that are not held out: at most ``per_class`` texts of each class reach the task that trains, none of over ``most_bytes`` bytes."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id")
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(order, "id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null and id is not null").filter(F.octet_length("text") <= most_bytes)
    # the sample is bounded by its parameter, so it may be broadcast, and its texts be one group
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).withColumn("part", F.lit(0))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        model = _fit_shares(t["text"], np.array(t["toxic"].to_pylist(), bool), shares)
        return pa.Table.from_pylist([model | {k: model[k].tobytes() for k in ("keys", "weights")}]).select(_FIELDS)

    found = rows.groupBy("part").applyInArrow(run, "keys binary, weights binary, bias double, start double, transition array<double>, text array<double>").toArrow().to_pylist()
    return _model(found[0]) if found else _fit_shares(pa.chunked_array([], pa.string()), np.zeros(0, bool), shares)


_FIELDS = ["keys", "weights", "bias", "start", "transition", "text"]


def _model(row: dict) -> dict:
    return row | {"keys": np.frombuffer(row["keys"], np.uint64), "weights": np.frombuffer(row["weights"], np.float64), "transition": tuple(row["transition"]), "text": tuple(row["text"])}


def _fit_shares(texts: pa.ChunkedArray, toxic: np.ndarray, shares: dict[int, int]) -> dict:
    """``fit`` with weights that restore the classes' shares of all labels."""
    used = {0: max(int((~toxic).sum()), 1), 1: max(int(toxic.sum()), 1)}
    return fit(texts, toxic, np.where(toxic, shares.get(1, 0) / used[1], shares.get(0, 0) / used[0]))


_tables: dict[bytes, tuple[int, np.ndarray]] = {}


NAMES = ("score", "n_toxic", "toxic_spans")


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with score double, n_toxic bigint and toxic_spans (start:end in code points of the words tagged toxic, comma-joined), under ``names``; clashing columns are replaced."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.LongType(), T.StringType()), strict=True)]])
    place, columns = docs.columns.index(text_col), [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = model["keys"].tobytes()
        if name not in _tables:
            _tables.clear()
            _tables[name] = slot_table(model["keys"])
        seed, table = _tables[name]
        for b in slices(batches, place):
            scores, counts, spans = [np.zeros(0)], [np.zeros(0, np.int64)], []
            for _, _, buf, off in text_chunks(b.column(place)):
                starts, ends, first, forms = words_and_forms(buf, off)
                p = score_words(forms, first, model, seed, table)
                scores.append(1 / (1 + np.exp(-np.clip(_features(p, first) @ np.array(model["text"]), -40, 40))))
                tagged = np.flatnonzero(p >= 0.5)
                row = np.searchsorted(first, tagged, side="right") - 1
                n = len(off) - 1
                counts.append(np.bincount(row, minlength=n))
                lists: list[list[str]] = [[] for _ in range(n)]
                if len(tagged):
                    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    base = points[off[row]]
                    for i, s, e in zip(row.tolist(), (points[starts[tagged]] - base).tolist(), (points[ends[tagged]] - base).tolist(), strict=True):
                        lists[i].append(f"{s}:{e}")
                spans += [",".join(x) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores)), pa.array(np.concatenate(counts)), pa.array(spans, pa.string())], columns)

    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their own columns."""
    names = tuple(free(docs, n) for n in NAMES)
    return score(docs, model, id_col, text_col, names).filter(F.col(names[0]) < threshold).select(docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "toxic_spans")
