"""Secret scan: two patterns propose candidates, a random forest removes the false positives.

Candidates are values assigned to a secret-like name, passwords between user and host of a URL, and all runs of key characters that hold a digit (from
``SHORT`` characters on) or inner capitals (from ``LONG`` on): card and order numbers, identifiers, digests and file
names are among them, and it is for the forest to tell them from keys.
Each gets features of its length, its letters (classes, entropy, transitions between classes, and its
likelihood as a chain of letter pairs), the share of it that dictionary words cover, the words beside it,
whether a password name or a URL holds it, and its path. The forest is Spark ML's, trained on labelled findings: rows of (before, value, after, path,
label). ``labelled_findings`` draws such rows from ``SHAPES``, the public shapes of keys and of what looks like them; pass
a DataFrame of reviewed findings to replace it.

A single dictionary word behind a password name is no secret ("password: required"); several words, or a word with digits or symbols, are.

Null and empty texts have no candidates, and an empty table gives no rows; null paths are empty. Rows that repeat an id are
scanned each on its own; equal rows of a finding count once in ``redact``. A tie (probability 0.5) is a secret. Texts of any length are scanned whole; memory
for one grows with its candidates. Input columns of any name come through ``redact`` as they are; ``scan`` reads only the three that it is told.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.llm.textkit import row_name, slices
from arcwave.plans.lineage import remove, shared_dir
from arcwave.plans.names import free

DICTIONARY = "/opt/tokenizers/word_bpe_49k.json"
TREES, DEPTH = 40, 9
FINDINGS = 6_000
AROUND = 48

ASSIGNED = re.compile(r"(?i)\b[\w.-]{0,40}?(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth|credential)[\w-]{0,40}[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"',;]{6,})")
URL_PASSWORD = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@\"']{0,64}:([^\s/@\"']{3,256})@")
SHORT, LONG = 8, 16
RUN = re.compile(rf"[A-Za-z0-9+/=_-]{{{SHORT},}}")
_PART = re.compile(r"[^=]+(?:={1,2}$)?")
_NAMES = re.compile(r"(?i)token|secret|passw|passphrase|pwd|api[_-]?key|access[_-]?key|private|auth|bearer|credential")
_PASSWORD_NAME = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd)[\w-]{0,12}[\"']?\s{0,4}[:=]\s{0,4}[\"']?$")
_USER = re.compile(r"://[^\s/:@\"']{0,64}:$")
_DIGEST = re.compile(r"(?i)sha-?\d|md5|commit|checksum|digest|hash|etag|revision|integrity|blob|uuid|guid|trace|request")
_SAMPLE = re.compile(r"(?i)example|sample|test|dummy|placeholder|your|fake|mock|changeme|xxxx|fixture")
_LOCK = re.compile(r"(?i)lock|\.sum$|\.svg$|\.map$|\.min\.|node_modules|vendor")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_HEX, _INNER = re.compile(r"(?i)[0-9a-f]+"), re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "distinct", "entropy", "transitions", "pair_likelihood", "hex", "hex_length", "uuid", "words",
    "longest_word", "repeats", "assigned", "quoted", "near_secret", "near_digest", "near_sample", "value_sample", "path_sample", "path_lock", "known_prefix",
    "password_name", "in_url", "one_word",
)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.")


class Describer:
    """Turns candidates into feature lists; built once in each Python worker."""

    def __init__(self, dictionary: str = DICTIONARY) -> None:
        with open(dictionary, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        words = [w[:-4] for w in vocabulary if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha()]
        self.words = frozenset(w for w in words if len(w) >= 4)
        pairs, single = Counter(), Counter()
        for w in words:
            pairs.update(zip(w, w[1:], strict=False))
            single.update(w[:-1])
        self.pairs = {p: math.log((c + 0.5) / (single[p[0]] + 13)) for p, c in pairs.items()}

    def coverage(self, value: str) -> tuple[float, int]:
        """Share of the value that non-overlapping dictionary words cover, longest first from the left; and the longest word."""
        low, covered, longest = value.lower(), 0, 0
        for run in re.findall(r"[a-z]{4,}", low):
            at = 0
            while at + 4 <= len(run):
                size = next((k for k in range(min(16, len(run) - at), 3, -1) if run[at : at + k] in self.words), 0)
                covered, longest, at = covered + size, max(longest, size), at + (size or 1)
        return covered / len(value), longest

    def features(self, before: str, value: str, after: str, path: str) -> list[float]:
        n = len(value)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
        share = Counter(kinds)
        counts = Counter(value)
        letters = value.lower()
        pairs = [self.pairs.get(p, -7.0) for p in zip(letters, letters[1:], strict=False) if p[0].isalpha() and p[1].isalpha()]
        words, longest = self.coverage(value)
        is_hex = bool(_HEX.fullmatch(value))
        near = before[-AROUND:]
        return [float(x) for x in (
            min(n, 400), share["d"] / n, share["u"] / n, share["l"] / n, share["s"] / n, len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, sum(pairs) / len(pairs) if pairs else -4.0, is_hex, n if is_hex else 0, bool(_UUID.fullmatch(value)), words,
            longest, max(counts.values()) / n, bool(re.search(r"[:=]\s*[\"']?$", near)), near[-1:] in ("'", '"') and after[:1] in ("'", '"'), bool(_NAMES.search(near)), bool(_DIGEST.search(near)),
            bool(_SAMPLE.search(near)), bool(_SAMPLE.search(value)), bool(_SAMPLE.search(path)), bool(_LOCK.search(path)), value.startswith(PREFIXES),
            bool(_PASSWORD_NAME.search(near)), after[:1] == "@" and bool(_USER.search(near)), longest == n,
        )]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in code points, by start; a value found both ways counts once, as the assigned one. Nothing else overlaps a URL's password.

    A long run is split at '=', which belongs to a value only as padding at its end; a shorter part behind '=' stays a value.
    """
    inside = [m.span(1) for m in URL_PASSWORD.finditer(text)] if "://" in text else []
    found = []
    for m in ASSIGNED.finditer(text) if _NAMES.search(text) else ():
        s, e = m.span(1)
        s += len(m[1]) - len(m[1].lstrip("="))
        if e - s >= 6:
            found.append((s, e))
    for m in RUN.finditer(text):
        for part in _PART.finditer(m[0]):
            v = part[0]
            if len(v) < (6 if part.start() else SHORT):
                continue
            if any(c.isdigit() for c in v) or len(v) >= LONG and _INNER.search(v):
                found.append((m.start() + part.start(), m.start() + part.end()))
    if inside:
        starts = [s for s, _ in inside]
        clear = lambda s, e: (k := bisect_left(starts, e)) == 0 or inside[k - 1][1] <= s
        found = [x for x in found if clear(*x)] + inside
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


# What values and their surroundings look like: shape -> (label, drawn by a random generator).

_HEXA, _ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
_PLAIN = "the value here was set for all of them in order with this one and then that from our last run".split()
_SECRET_NAMES = ("token", "api_key", "apiKey", "secret", "client_secret", "password", "auth_token", "AWS_SECRET_ACCESS_KEY", "access_key")
_OTHER_NAMES = ("id", "user_id", "order", "ref", "version", "name", "session", "build", "sku", "invoice", "track", "color", "file")
_DIGEST_NAMES = ("sha256:", "sha1 ", "commit ", "checksum: ", "md5: ", 'etag: "', "digest = ", 'integrity="', "revision ", "trace id ", "uuid: ")
_PATHS = ("src/app.py", "config/settings.yml", "deploy/env", "web", "notes.md", "src0", "")
_COMPOUND = ("user", "account", "request", "handler", "factory", "service", "manager", "config", "builder", "stream", "version")
_PASSWORD_NAMES = ("password", "passwd", "db_password", "passphrase", "pwd", "user-password", "MYSQL_PASSWORD")
_FIELD_WORDS = ("required", "optional", "string", "forgotten", "expired", "wrong", "missing", "policy", "incorrect", "strength", "changed", "protected")
_NOUNS = (
    "river", "candle", "monkey", "dragon", "summer", "winter", "purple", "silver", "garden", "bridge", "coffee", "planet", "guitar", "rocket", "sunshine", "forest", "thunder", "marble",
    "pencil", "window", "orange", "castle", "falcon", "tiger", "butter", "ladder", "mirror", "ocean", "pepper", "saddle", "tunnel", "velvet", "whale", "yellow", "anchor", "basket",
)
_SCHEMES = ("postgres://", "mysql://", "https://", "redis://", "mongodb+srv://", "ftp://", "amqp://")
_URL_STAND_INS = ("password", "PASSWORD", "<password>", "${DB_PASSWORD}", "$PASS", "{password}", "xxxxx", "****", "changeme", "your-password", "%s")
_STAND_INS = ("your_api_key_here", "YOUR-TOKEN-HERE", "xxxxxxxxxxxxxxxx", "changeme1234", "example_token_1", "<redacted>", "${API_TOKEN}", "os.environ[TOKEN]", "dummy-secret-123", "process.env.SECRET_KEY")


def _draw(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choices(alphabet, k=n))


def _prose(rng: random.Random) -> str:
    return " ".join(rng.choices(_PLAIN, k=4)) if rng.random() < 0.5 else " ".join(_draw(rng, string.ascii_lowercase, rng.randint(2, 11)) for _ in range(4))


def _assignment(rng: random.Random, names: tuple[str, ...] = _SECRET_NAMES) -> str:
    name = rng.choice(names)
    return (name.upper() if rng.random() < 0.15 else name) + rng.choice([" = ", "=", ": ", " := "])


def _compound(rng: random.Random) -> str:
    return "".join(w.title() for w in rng.choices(_COMPOUND, k=rng.randint(2, 4))) + rng.choice(["", "2", "V1", "_test"])


def _uuid(rng: random.Random) -> str:
    return "-".join(_draw(rng, _HEXA, k) for k in (8, 4, 4, 4, 12))


def _word_and_number(rng: random.Random) -> str:
    return _draw(rng, string.ascii_lowercase, rng.randint(2, 12)) + rng.choice(["", "-", "_"]) + _draw(rng, string.digits, rng.randint(1, 6)) + rng.choice(["", "-", "_", "/"]) + _draw(rng, string.ascii_lowercase, rng.randint(3, 12))


def _passphrase(rng: random.Random) -> str:
    words = rng.choices(_NOUNS, k=rng.randint(3, 5)) if rng.random() < 0.7 else [_syllables(rng) for _ in range(3)]
    return rng.choice(["", "", "-", "_", "."]).join(w.title() if rng.random() < 0.2 else w for w in words)


def _syllables(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 3)))


def _word_password(rng: random.Random) -> str:
    word = rng.choice(_NOUNS) if rng.random() < 0.6 else _syllables(rng)
    if rng.random() < 0.3:
        word = word.translate(str.maketrans("aeios", rng.choice(["4e10s", "@3i05", "4310$"])))
    word = word.title() if rng.random() < 0.4 else word
    return (word + _draw(rng, string.digits, rng.randint(1, 4)) + rng.choice(["", "", "!", "#", "?"])).ljust(6, "1")


def _plain_word(rng: random.Random) -> str:
    return rng.choice(_FIELD_WORDS) if rng.random() < 0.5 else rng.choice([w for w in _NOUNS if len(w) > 5])


def _folder(rng: random.Random) -> str:
    return "/" + "/".join(rng.choices(_NOUNS, k=rng.randint(2, 4)))


def _date(rng: random.Random) -> str:
    return rng.choice(["{}-{:02}-{:02}", "{}{:02}{:02}", "{}/{:02}/{:02}", "{}-{:02}-{:02}T10"]).format(rng.randint(1970, 2030), rng.randint(1, 12), rng.randint(1, 28))


#: shape: (label, value, how it is led in, path or None for any). A lead of "assigned" names a secret, "password" a password, "url" stands between user and host, "bare" nothing, "mostly" mostly the first.
SHAPES = {
    "hex key": (1, lambda r: _draw(r, _HEXA, r.choice([32, 40, 40, 64])), "assigned", None),
    "access id": (1, lambda r: "AKIA" + _draw(r, string.ascii_uppercase + string.digits, 16), "mostly", None),
    "prefixed key": (1, lambda r: r.choice(["ghp_", "sk_live_", "xoxb-"]) + _draw(r, _ALNUM, r.choice([24, 36])), "mostly", None),
    "deploy token": (1, lambda r: "glpat-" + _draw(r, _ALNUM + "_-", 20), "mostly", None),
    "secret key": (1, lambda r: _draw(r, _ALNUM + "+/", 40), "assigned", None),
    "password": (1, lambda r: _draw(r, _ALNUM + "!@#$%^&*", r.randint(10, 24)), "assigned", None),
    "signed token": (1, lambda r: "eyJ" + _draw(r, _ALNUM + "_-", r.randint(40, 120)), "mostly", None),
    "url-safe key": (1, lambda r: _draw(r, _ALNUM + "_-", r.randint(22, 64)), "assigned", None),
    "passphrase": (1, _passphrase, "password", None),
    "word password": (1, _word_password, "password", None),
    "url password": (1, lambda r: r.choice([_word_password, _passphrase, lambda r: _draw(r, _ALNUM + "!#$%^&*", r.randint(8, 24))])(r), "url", None),
    "digest": (0, lambda r: _draw(r, _HEXA, r.choice([32, 40, 64])), _DIGEST_NAMES, None),
    "short commit": (0, lambda r: _draw(r, _HEXA, r.randint(8, 12)), ("commit ", "revision ", "", "at "), None),
    "uuid": (0, _uuid, (*_DIGEST_NAMES, "id ", "key ", "id: "), None),
    "identifier": (0, _compound, ("class ", "new ", "return ", "", "token = "), None),
    "stand-in": (0, lambda r: r.choice(_STAND_INS), "assigned", None),
    "url stand-in": (0, lambda r: r.choice(_URL_STAND_INS), "url", None),
    "plain word": (0, _plain_word, "password", None),
    "password code": (0, lambda r: r.choice(["getpass.getpass()", "user.password", "request.password", "config.get(PASSWORD)", "$(cat secret)", "self._password", "hash_password(raw)"]), "password", None),
    "folder": (0, _folder, ("pwd: ", "PWD=", "pwd = "), None),
    "named word": (0, lambda r: r.choice([_word_password, _passphrase])(r), "other", None),
    "word and number": (0, _word_and_number, "bare", None),
    "file name": (0, lambda r: "-".join(r.choices(_PLAIN, k=5)) + r.choice(["-2", "-2024", "_v3", "/1"]), "bare", None),
    "number": (0, lambda r: _draw(r, string.digits, r.randint(8, 19)), "bare", None),
    "named number": (0, lambda r: _draw(r, string.digits, r.randint(8, 19)), "other", None),
    "phone": (0, lambda r: "-".join(_draw(r, string.digits, k) for k in r.choice([(3, 3, 4), (1, 3, 3, 4), (4, 4, 4, 4)])), "bare", None),
    "date": (0, _date, "bare", None),
    "order id": (0, lambda r: _draw(r, string.ascii_uppercase, r.randint(2, 4)) + "-" + _draw(r, string.digits, r.randint(5, 10)), "other", None),
    "named hex": (0, lambda r: _draw(r, _HEXA, r.choice([8, 16, 24, 32])), "other", None),
    "integrity": (0, lambda r: _draw(r, _ALNUM + "+/", 86) + "==", (' integrity="sha512-',), "package-lock.json"),
    "inline image": (0, lambda r: _draw(r, _ALNUM + "+/", r.randint(40, 200)), (" data:image/png;base64,",), None),
    "fixture": (0, lambda r: _draw(r, _HEXA, 40), "assigned", "tests/fixtures/keys.py"),
}


def labelled_findings(n: int = FINDINGS, seed: int = 11, shapes: Collection[str] = tuple(SHAPES)) -> list[tuple[str, str, str, str, int]]:
    """(before, value, after, path, label) rows, keys (1) and what looks like them (0) in turn, each side's ``shapes`` in turn."""
    rng = random.Random(seed)
    sides = [[k for k in SHAPES if k in shapes and SHAPES[k][0] == y] for y in (0, 1)]
    rows = []
    for i in range(n):
        side = sides[i % 2] or sides[1 - i % 2]
        label, value, lead, path = SHAPES[side[i // 2 % len(side)]]
        quote = rng.choice(['"', "'", ""])
        if lead == "mostly":
            lead = "assigned" if rng.random() < 0.7 else "bare"
        if lead == "assigned":
            before = _assignment(rng) + quote
        elif lead == "other":
            before = _assignment(rng, _OTHER_NAMES) + quote
        elif lead == "password":
            before = _assignment(rng, _PASSWORD_NAMES) + quote
        elif lead == "url":
            before, quote = quote + rng.choice(_SCHEMES) + rng.choice(["admin", "root", "user", "svc", "app", _syllables(rng)]) + ":", "@" + rng.choice(_NOUNS) + rng.choice([".com/", ".internal:5432/", "/"]) + quote
        else:
            before, quote = ("" if lead == "bare" else rng.choice(lead)), rng.choice(["", "", quote])
            before += quote
        drawn = value(rng)
        drawn = drawn.upper() if lead not in ("password", "url") and rng.random() < 0.1 else drawn
        tail = quote + rng.choice([" ", "\n", "; ", "!! ", ", ", "."]) + _prose(rng)
        rows.append((_prose(rng) + " " + before, drawn, tail, path or rng.choice(_PATHS), label))
    return rows


_describers: dict[str, Describer] = {}


def _describer(dictionary: str) -> Describer:
    if dictionary not in _describers:
        _describers[dictionary] = Describer(dictionary)
    return _describers[dictionary]


def train(spark: SparkSession, findings: DataFrame | None = None, dictionary: str = DICTIONARY) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, value, after, path strings; label 0 or 1); rows without a value or label are left out."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "before string, value string, after string, path string, label int").coalesce(1)
    rows = findings.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "value", "after", "path")], "label").filter("value <> '' and label in (0, 1)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = _describer(dictionary).features
        for b in batches:
            x = [describe(*r) for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(4).cast(pa.float64())], ["x", "label"])

    described = rows.mapInArrow(run, "x array<double>, label double").withColumn("features", array_to_vector("x")).select("features", "label")
    # written and read again: a fitted model drags its training summary, and with it the session, into tasks
    path = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=2).fit(described).write().save(path)
    model = RandomForestClassificationModel.load(path)
    remove(spark, path)
    return model


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", dictionary: str = DICTIONARY) -> DataFrame:
    """Every candidate: (id, key binary, start, end in code points, value, probability double, secret boolean). ``key`` names the row by its id and text."""
    kind = docs.schema[id_col].dataType.simpleString()
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path")).filter("text <> ''").withColumn("key", row_name("id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = _describer(dictionary).features
        for b in slices(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                for s, e in candidates(text):
                    value = text[s:e]
                    x = describe(text[max(0, s - AROUND) : s], value, text[e : e + AROUND], b.column(2)[i].as_py() or "")
                    for to, v in zip(out, (i, s, e, value, x), strict=True):
                        to.append(v)
            row = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(3).take(row), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.float64()))], ["id", "key", "start", "end", "value", "x"])

    found = rows.mapInArrow(run, f"id {kind}, key binary, start bigint, end bigint, value string, x array<double>")
    scored = model.transform(found.withColumn("features", array_to_vector("x")))
    return scored.select(F.col("id").alias(id_col), "key", "start", "end", "value", F.element_at(vector_to_array("probability"), 2).alias("probability")).withColumn("secret", F.col("probability") >= 0.5)


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets of ``found`` (from ``scan`` of the same docs) replaced; other columns stay."""
    columns = docs.columns
    key, spans, place = free(docs, "key"), free(docs, "spans"), columns.index(text_col)
    marked = found.filter("secret").groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans))
    rows = docs.withColumn(key, row_name(id_col, text_col)).join(marked, key, "left").select(*columns, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, place):
            texts = b.column(place)
            hit = pc.is_valid(b.column(len(b.columns) - 1))
            if hit.true_count:
                clean: list[str | None] = [None] * b.num_rows
                for i in pc.indices_nonzero(hit).to_pylist():
                    text, at, parts = texts[i].as_py(), 0, []
                    for x in b.column(len(b.columns) - 1)[i].as_py():
                        parts += [text[at : x["start"]], mark]
                        at = x["end"]
                    clean[i] = "".join([*parts, text[at:]])
                texts = pc.if_else(hit, pa.array(clean, texts.type), texts)
            yield pa.RecordBatch.from_arrays([texts if k == place else b.column(k) for k in range(len(columns))], columns)

    return rows.mapInArrow(run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = scan(docs, train(spark))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "secret")
