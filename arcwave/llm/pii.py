"""Personal data: exact base spans, and information-theoretic sanitisation of the terms that give them away.

Base spans (email, ip, card, phone) come from four patterns and their checks. Every word of a text that holds a base
span is a candidate quasi-identifier, wherever it stands. Over the whole corpus, a term t discloses an entity e to the degree

    PMI(t; e) / IC(e),   PMI = log2(N c(t, e) / (c(t) c(e))),   IC = log2(N / c(e)),

which is 1 when t never occurs without e. All counts are rows of the corpus that hold t, e, or both; a pair is judged
only if at least ``support`` different texts hold both, so copies of one text prove nothing. In a text that holds e,
all occurrences of the terms at or over ``threshold`` become spans of kind ``term``, except where a base span
overlaps them, and are generalised in the sanitised text.

Terms (and entities) that stand in exactly the same texts have the same counts, so they are judged as one class, named by
two 64-bit hashes of that set of texts, and only terms rare enough for an entity are paired with it (PMI bounds c(t) by
c(e) ** threshold * N ** (1 - threshold)). A text of many classes of both, such as a directory, lists only pairs that another
text can hold too; where two such texts share n people, all pairs of these are supported, and are listed.

Only DataFrame functions run here. Null and empty texts have no spans, and an empty table gives no rows; rows that repeat an
id and text get the same answer; null ids are kept. Ties cannot arise: spans are fixed by the patterns, terms by counts. Texts may
be of any length: work and memory for one grow with its length and its spans. Columns of the input that are named like
those used here do not matter; ``sanitise`` replaces a column ``n_spans``. Counts use map-side combination, and joins on an
entity, term or text that many rows hold are dealt over tasks. Tables are broadcast only up to ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwave.plans.lineage import cut
from arcwave.plans.names import free
from arcwave.plans.spread import small, spread_join

KINDS = ("email", "ip", "card", "phone", "term")
# The stated patterns, with possessive repeats and run-start guards: the same matches in linear time and constant stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]++"
MIN_TERM = 2
SUPPORT = 2
THRESHOLD = 0.9
BROADCAST_ROWS = 200_000
HEAVY = 1 << 16  # entity classes times term classes of a text whose pairs are no longer listed
HEAVY_ROWS = 256  # term classes of a heavy text that one task pairs
CHUNK = 64
BLOCK = 4096  # code points of a piece of text in which spans are replaced

_SPAN = "array<struct<s:int,e:int,v:string>>"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _running(values: Column, depth: int = 2) -> Column:
    """Running sums of an array of numbers. An accumulated array is copied at each step, so sums run inside chunks of ``CHUNK``, and over the chunks' totals in the same way."""

    def plain(part: Column) -> Column:
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
        return F.aggregate(part, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    if not depth:
        return plain(values)
    last = lambda part: F.coalesce(F.get(part, F.size(part) - 1), F.lit(0))
    chunks = _bound(values, lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), lambda b: F.slice(v, b * CHUNK + 1, CHUNK)))

    def joined(parts: Column) -> Column:
        through = _running(F.transform(parts, last), depth - 1)
        return F.flatten(F.zip_with(parts, through, lambda part, total: F.transform(part, lambda x: x + total - last(part))))

    return _bound(F.transform(chunks, plain), joined)


def _located(found: Column, pieces: Column) -> Column:
    """Spans of ``found``, the matches between ``pieces`` of a text, in code points."""
    ends = lambda values: _running(F.zip_with(values, F.slice(pieces, F.lit(1), F.size(values)), lambda v, g: F.length(v) + F.length(g)))
    return _bound(found, lambda values: F.zip_with(values, ends(values), lambda v, e: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("v"))))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.reverse(_digits(v))
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) >= 5, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i))
    return n.between(12, 19) & (total % 10 == 0)


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: _passes(kind, x["v"])


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        # leading zeros aside, a part of over 3 digits is over 255
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        small = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255
        return F.forall(F.split(v, r"\."), lambda p: part(p) & small(p))
    if kind == "card":
        return F.when(F.length(_digits(v)).between(12, 19), _luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match of this kind meets."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": F.contains(text, F.lit("."))}.get(kind, F.lit(True))


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the arrays email, ip, card and phone of (s, e, v): code points, end exclusive."""
    for kind, pattern in PATTERNS.items():
        none = F.array().cast("array<string>")
        rows = rows.withColumn(kind, F.when(_hint(kind, F.col(text)), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        rows = rows.withColumn(kind, F.when(F.size(kind) > 0, _located(F.col(kind), F.split(F.col(text), pattern, -1))).otherwise(F.array().cast(_SPAN)))
    for kind in PATTERNS:
        if kind != "email":
            rows = rows.withColumn(kind, F.filter(kind, _valid(kind)))
    return rows


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key, h): ``key`` names a row by its id and text, ``h`` its text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text")).withColumn("h", F.xxhash64("text"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: id, key, h, and the base spans, by kind and all together."""
    rows = base_spans(_texts(docs, id_col, text_col))
    entity = lambda k: F.transform(F.col(KINDS[k]), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    return rows.select("id", "key", "h", *KINDS[:4], F.array_sort(F.concat(*[entity(k) for k in range(4)])).alias("base"))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    words = F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.lower(w))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= MIN_TERM)


def _set_name(other: str) -> list[Column]:
    """Two hashes of the set of ``other`` in a group."""
    return [F.bit_xor(F.xxhash64(F.col(other), F.lit(k))).alias(f"x{k}") for k in (0, 1)]


def _meetings(classes: DataFrame, posted: DataFrame, support: int, rare: Callable[[str], Column]) -> DataFrame:
    """(ec, tc, d, c_te, c_e, c_t): how many texts, and rows, hold both; pairs in fewer than ``support`` texts may be missing or counted in part.

    Pairs of a text with at most ``HEAVY`` of them are listed. A pair of a heavy text matters only if a light text holds it too, or another
    heavy one; then it also stands in a heavy text that is not the heaviest of its entity class, nor of its term class. Such
    pairs are looked up in the heavy texts, so a directory of n people costs n times the texts of each, not n * n.
    """
    counted = lambda met: met.groupBy("ec", "tc").agg(F.count(F.lit(1)).alias("d"), F.sum("m").alias("c_te"), F.min("c_e").alias("c_e"), F.min("c_t").alias("c_t"))
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(posted.groupBy("h").agg(F.count(F.lit(1)).alias("k")), "h")
    heavy = cut(sizes.select("h", (F.col("n") * F.col("k")).alias("w")).filter(F.col("w") > HEAVY))
    if heavy.isEmpty():
        return counted(classes.join(posted, "h").filter(rare("c_e")))
    heavy = small(heavy, BROADCAST_ROWS)
    light = cut(counted(classes.join(heavy, "h", "left_anti").join(posted, "h").filter(rare("c_e"))))
    held, words = (cut(rows.join(heavy, "h")) for rows in (classes.select("h", "ec", "m", "c_e"), posted))

    def behind(rows: DataFrame, name: str) -> DataFrame:
        """Rows outside the heaviest text of their class; all rows, where one text is support enough."""
        if support < 2:
            return rows.drop("w")
        place = F.struct("w", "h")
        return rows.join(rows.groupBy(name).agg(F.max(place).alias("top")), name).filter(place < F.col("top")).drop("w", "top")

    fresh = spread_join(cut(behind(words, "tc")), behind(held, "ec").select("h", "ec", "c_e"), ["h"], "tc", task_rows=HEAVY_ROWS).filter(rare("c_e")).select("ec", "tc")
    seen = light.join(held.select("ec").distinct(), "ec", "left_semi").join(words.select("tc").distinct(), "tc", "left_semi").select("ec", "tc")
    pairs = cut(fresh.unionByName(seen).distinct())
    met = spread_join(pairs, held.select("h", "ec", "m", "c_e"), ["ec"], "tc").join(words.select("h", "tc", "c_t"), ["h", "tc"])
    both = light.unionByName(counted(met))
    return both.groupBy("ec", "tc").agg(F.sum("d").alias("d"), F.sum("c_te").alias("c_te"), F.min("c_e").alias("c_e"), F.min("c_t").alias("c_t"))


def _telling(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, support: int, threshold: float) -> DataFrame | None:
    """(h, t): the terms of each text that disclose an entity in it; None if no two texts share an entity."""
    n = float(found.count())
    names = F.array_distinct(F.transform("base", lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["v"])))  # strings, which are made distinct by hashing
    held = found.filter(F.size("base") > 0).select("h", "key", F.explode(names).alias("v"))
    held = cut(held.groupBy("h", "v").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key")))
    entities = held.groupBy("v").agg(F.count(F.lit(1)).alias("d"), F.sum("m").alias("c_e"), *_set_name("h")).filter((F.col("d") >= support) & (F.col("c_e") < n))
    entities = cut(entities.select("v", "c_e", F.xxhash64("x0", "x1", "d", "c_e").alias("ec")))
    most = entities.agg(F.max("c_e")).first()[0]
    if most is None:
        return None
    classes = cut(spread_join(held, small(entities, BROADCAST_ROWS), ["v"], "h").groupBy("h", "ec").agg(F.min("key").alias("key"), F.min("m").alias("m"), F.min("c_e").alias("c_e")))

    # the terms of the texts that share an entity, one row of each text
    one = small(cut(classes.groupBy("h").agg(F.min("key").alias("key")).select("key")), BROADCAST_ROWS)
    rows = _texts(docs, id_col, text_col)
    words = cut(rows.join(one, "key", "left_semi").select("h", F.explode(terms_of(F.col("text"))).alias("t")).distinct())
    terms = cut(words.groupBy("t").agg(F.count(F.lit(1)).alias("d"), *_set_name("h")).filter(F.col("d") >= support))
    known = small(terms.select("t"), BROADCAST_ROWS)
    counts = rows.select(F.explode(terms_of(F.col("text"))).alias("t")).join(known, "t").groupBy("t").agg(F.count(F.lit(1)).alias("c_t"))
    rare = lambda c_e: F.log2("c_t") <= threshold * F.log2(c_e) + (1 - threshold) * F.log2(F.lit(n)) + 1e-9
    terms = cut(terms.join(counts, "t").filter(rare(F.lit(most))).select("t", "c_t", F.xxhash64("x0", "x1", "d", "c_t").alias("tc")))
    words = cut(spread_join(words, small(terms, BROADCAST_ROWS), ["t"], "h"))

    pairs = _meetings(classes, cut(words.select("h", "tc", "c_t").distinct()), support, rare).filter(F.col("d") >= support)
    information = F.log2(F.lit(n) / F.col("c_e"))
    pmi = F.log2(F.lit(n) * F.col("c_te") / (F.col("c_t").cast("double") * F.col("c_e")))
    telling = cut(pairs.filter(pmi >= threshold * information - 1e-9).select("ec", "tc"))
    told = spread_join(classes.select("h", "ec"), small(telling, BROADCAST_ROWS), ["ec"], "h").select("h", "tc").distinct()
    return cut(words.join(told, ["h", "tc"], "left_semi").select("h", "t"))


def _term_spans(found: DataFrame, docs: DataFrame, told: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, terms): the places of the told terms of each text that no base span overlaps."""
    first = cut(found.join(told.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("key").alias("key")))
    rows = _texts(docs, id_col, text_col).join(small(first.select("key"), BROADCAST_ROWS), "key", "left_semi")
    words = F.explode(_located(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)))
    places = rows.select("h", words.alias("x")).select("h", "x.s", "x.e", F.lower("x.v").alias("t")).join(told, ["h", "t"], "left_semi").distinct()
    base = found.join(small(first.select("key"), BROADCAST_ROWS), "key", "left_semi").select("h", F.explode("base").alias("x")).select("h", "x.s", "x.e", F.lit(None).cast("string").alias("t")).distinct()
    # a term overlaps the base span that ends last among those that start before it, or the next one
    own = lambda c: F.when(F.col("t").isNull(), F.col(c))
    running = lambda *order: Window.partitionBy("h").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = places.select("h", "s", "e", "t").unionByName(base).withColumn("behind", F.max(own("e")).over(running("s", F.col("t").isNotNull())))
    marked = marked.withColumn("ahead", F.min(own("s")).over(running(F.desc("s"), F.col("t").isNull())))
    clear = marked.filter("t is not null and coalesce(behind <= s, true) and coalesce(ahead >= e, true)")
    return clear.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("s", F.lit(4).alias("k"), "e", F.col("t").alias("v")))).alias("terms"))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, email, ip, card, phone, base, terms) for every row; base and terms are arrays of (s, k, e, v) by start, k an index of ``KINDS``."""
    found = cut(_found(docs, id_col, text_col))
    told = _telling(found, docs, id_col, text_col, support, threshold)
    none = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    if told is None:
        return found.drop("h").withColumn("terms", none).withColumnRenamed("id", id_col)
    out = spread_join(found, cut(_term_spans(found, docs, told, id_col, text_col)), ["h"], "key", "left")
    return out.drop("h").withColumn("terms", F.coalesce("terms", none)).withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def _tag(k: Column, v: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.when(k == 4, F.when(v.rlike("^[0-9]+$"), "[NUMBER]").otherwise("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def _replaced(rows: DataFrame) -> DataFrame:
    """(key, clean) from (key, text, spans): overlapping spans are replaced as one, by the tag of the first. Texts are cut into blocks, so no span costs a walk through its text."""
    spans = rows.select("key", F.explode("spans").alias("x")).select("key", "x.s", "x.e", F.struct("x.k", "x.v").alias("what"))
    before = Window.partitionBy("key").orderBy("s", "what.k", "e")
    fresh = F.coalesce(F.col("s") >= F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = spans.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min(F.when(F.col("fresh"), F.col("what"))).alias("what"))
    cuts = runs.withColumn("b", F.explode(F.sequence(F.expr(f"s div {BLOCK}"), F.expr(f"(e - 1) div {BLOCK}"))))
    low = F.col("b") * BLOCK
    cuts = cuts.select(
        "key", "b", F.greatest(F.col("s") - low, F.lit(0)).cast("int").alias("s"), F.least(F.col("e") - low, F.lit(BLOCK)).cast("int").alias("e"),
        F.when(F.col("s") >= low, _tag(F.col("what.k"), F.col("what.v"))).otherwise("").alias("tag"),
    )
    cuts = cuts.groupBy("key", "b").agg(F.array_sort(F.collect_list(F.struct("s", "e", "tag"))).alias("cuts"))
    blocks = rows.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("b", "piece"))
    blocks = blocks.join(cuts, ["key", "b"], "left")
    piece = F.col("piece")
    step = lambda acc, x: F.struct(x["e"].alias("pos"), F.concat(acc["out"], F.substring(piece, acc["pos"] + 1, x["s"] - acc["pos"]), x["tag"]).alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(piece, acc["pos"] + 1, F.lit(BLOCK)))
    clean = F.aggregate("cuts", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, rest)
    blocks = blocks.select("key", F.struct("b", F.coalesce(clean, piece).alias("piece")).alias("x"))
    return blocks.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("clean"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span replaced: base spans by their kind, terms by their class (a number, or a word); and ``n_spans``."""
    key, clean, count = free(docs, "key"), free(docs, "clean"), "n_spans"
    rows = docs.drop(count).withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    spans = private_spans(docs, id_col, text_col, support, threshold).select("key", F.concat("base", "terms").alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["key"])
    spans = cut(spans)
    texts = rows.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")).join(spans, "key").dropDuplicates(["key"])
    done = _replaced(cut(texts)).join(spans.select("key", F.size("spans").cast("bigint").alias("n")), "key")
    done = done.select(F.col("key").alias(key), F.col("clean").alias(clean), F.col("n").alias(count))
    out = rows.join(done, key, "left").withColumn(text_col, F.coalesce(clean, F.col(text_col).cast("string"))).withColumn(count, F.coalesce(count, F.lit(0).cast("bigint")))
    return out.select(*[c for c in docs.columns if c != count], count)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("bigint").alias("n_term"))
