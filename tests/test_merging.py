"""Components of a stream, merged in keyed state."""

import random

from pyspark.sql import functions as F

from arcwave.streaming import merging
from test_queries import test_query_matches_sql as matches_sql


def grouped(edges):
    """{(part, vertex): (least, size)} by repeated merging of sets."""
    sets = {}
    for p, a, b in edges:
        if p is None or (a is None and b is None):
            continue
        a, b = (b if a is None else a), (a if b is None else b)
        both = sets.get((p, a), {a}) | sets.get((p, b), {b})
        for v in both:
            sets[p, v] = both
    return {k: (min(s), len(s)) for k, s in sets.items()}


def test_follows_a_rebuild(spark, tmp_path):
    """Three runs of one query, the later ones on its kept state; each equals a rebuild of all edges so far."""
    rng = random.Random(3)
    source, store, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = [(rng.randrange(4), rng.randrange(-30, 30), rng.randrange(-30, 30)) for _ in range(60)]
    second = [(p, rng.randrange(-30, 30), rng.randrange(-30, 30)) for p in range(4) for _ in range(8)] + [(None, 1, 2), (9, None, 5), (9, 6, None), (9, None, None), (9, 7, 7)]
    large = [(7, k, k + 1) for k in range(400)]
    p, a, b = large[3]
    seen, sizes = [], []
    for batch in (first + large, second, [(p, a, b + 50), (p, b, a), (p, 1000, a), (9, 5, 6)]):
        spark.createDataFrame(batch, "part int, src bigint, dst bigint").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("part int, src bigint, dst bigint").parquet(source)
        merging.keep(stream, store, state, once=True).awaitTermination(120)
        seen += batch
        stored = spark.read.parquet(store)
        got = {(r["part"], r["vertex"]): (r["component"], r["size"]) for r in merging.labels(stored).collect()}
        assert got == grouped(seen)
        sizes.append(stored.filter(F.col("batch") == stored.agg(F.max("batch")).first()[0]).count())
    # the last batch adds a vertex to a component of 401 and joins two others: two vertices each change, 401 stay as they are
    assert sizes[2] == 4


def test_strings_and_nothing(spark, tmp_path):
    source, store, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("x", "b", "a"), ("x", "c", "b"), ("x", "c", "b"), ("", "z", "z")], "p string, s string, t string").write.parquet(source)
    merging.keep(spark.readStream.schema("p string, s string, t string").parquet(source), store, state, once=True).awaitTermination(120)
    got = sorted(map(tuple, merging.labels(spark.read.parquet(store)).collect()))
    assert got == [("", "z", "z", 1), ("x", "a", "a", 3), ("x", "b", "a", 3), ("x", "c", "a", 3)]
    assert merging.labels(spark.read.parquet(store).limit(0)).count() == 0


def test_stream_query_matches_sql(spark, sf_dir):
    matches_sql(spark, sf_dir, "stream_components")


class _Counted(dict):
    """A map of state that counts its calls."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, row):  # noqa: N802
        self.calls += 1
        self[key] = row


class _Value:
    row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def test_a_batch_takes_a_few_state_calls(monkeypatch):
    """A call for each page that a batch touches; it was some for each vertex. Pages are split as the part grows."""
    for page, names in ((4_096, int), (8, int), (8, str)):
        monkeypatch.setattr(merging, "PAGE", page)
        rng, seen, last = random.Random(page), [], {}
        merge = merging.Merge(None)
        merge.pages, merge.turn = _Counted(), _Value()
        for _ in range(4):
            batch = [(7, names(rng.randrange(900)), names(rng.randrange(900))) for _ in range(150)]
            seen += batch
            frame = merging.pd.DataFrame(batch, columns=["part", "src", "dst"])
            for rows in merge.handleInputRows((7,), iter([frame]), None):
                last.update({r.vertex: (r.root, r.least, r.size) for r in rows.itertuples()})
        got = {(7, v): last[root][1:] for v, (root, _, _) in last.items()}
        assert got == grouped(seen)
        assert page == 8 or merge.pages.calls == 8
        assert page > 8 or len(merge.pages) > 64
