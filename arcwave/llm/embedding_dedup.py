"""Embedding near-dedup with a pivot-permutation index.

A sample of the vectors (``pivot_count``: about 2 sqrt(n), between 32 and ``MAX_PIVOTS``, by smallest hash)
are pivots. Each vector is described by its ``PREFIX`` nearest pivots in order and stands in the inverted lists of all pairs
of them, as two vectors are candidates if they share at least ``SHARED`` (two or more) of these pivots. So lists have some dozen
vectors whatever n is, unless the vectors themselves crowd. Candidates are verified by their cosine in double precision. A pair
is looked at only in the list of its two smallest shared pivots, so links can be counted in place and only a spanning
set of them leaves a task.

The lists of one smaller pivot lie in one task, or are dealt over as many as it takes to hold ``BLOCK`` vectors each; so a vector
is sent once to a task, at most 28 times in all, and less than 8 times where no pivot has many. A task that still has over ``BLOCK``
vectors (crowded lists) is cut into blocks, and every pair of blocks is a task of its own: no list meets in one task,
and no pair is left out.

Equal vectors are one class with a multiplicity.
Vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of other
lengths than their partner; vectors without an id link with nothing too and are kept. Rows that repeat an id and a
vector count once as partners. A cosine links if dot / (norm * norm), each in doubles, is the threshold or more, so one of exactly the threshold links
where that formula does not round it below; equally near pivots count in the order of their sample; of ids the
smallest names a component. An empty table gives no rows. Vectors may have any length; tasks hold some ``2 * BLOCK`` of them. Input columns
of any other name are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.operators.components import connected_components
from arcwave.plans.lineage import cut
from arcwave.plans.spread import small

THRESHOLD = 0.9
PREFIX = 8
SHARED = 2
BLOCK = 2048
MIN_PIVOTS, MAX_PIVOTS = 32, 16_384
SPREAD = 2_654_435_761
BAND = 1e-9


def pivot_count(n: int) -> int:
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * n**0.5)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which rounds nothing, so that squares neither overflow nor vanish."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of ``a`` and of ``b`` (both scaled) whether dot / (norm * norm) in doubles is ``threshold`` or more.

    A product of unit vectors decides, but for pairs within ``BAND`` of the threshold, which are computed in the order of that formula:
    there rounding before the product would decide.
    """
    far = _unit(a) @ _unit(b).T
    near = far >= threshold
    x, y = np.nonzero(np.abs(far - threshold) <= BAND)
    for k in range(0, len(x), 8192):
        p, q = a[x[k : k + 8192]], b[y[k : k + 8192]]
        dot, norms = (p * q).sum(axis=1), np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
        near[x[k : k + 8192], y[k : k + 8192]] = dot / norms >= threshold
    return near


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def dealt(q: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` tasks has the list of the larger pivot ``q``."""
    return (q.astype(np.int64) * SPREAD) % (1 << 32) % parts


def linked_in_lists(table: pa.Table, threshold: float, shared: int) -> pa.Table:
    """One block pair of some lists of one smaller pivot: (rep, n, to), the links of each vector counted with multiplicity, and the smallest id that they lead to here."""
    pivot, sub, parts, i, j = (table.column(c)[0].as_py() for c in ("pivot", "sub", "parts", "i", "j"))
    table = table.sort_by("rep")
    rep, mult, block = (table.column(c).to_numpy() for c in ("rep", "mult", "block"))
    perm = np.sort(_matrix(table.column("perm").combine_chunks()), axis=1)
    vectors = _scaled(_matrix(table.column("embedding").combine_chunks()))
    row, at = np.nonzero((perm > pivot) & (dealt(perm, parts) == sub))
    q = perm[row, at]
    order = np.argsort(q, kind="stable")  # rows stay ascending in a list
    row, q = row[order], q[order]
    ends = np.append(np.flatnonzero(np.diff(q)) + 1, len(q))
    count, root, top = np.zeros(len(rep), np.int64), np.arange(len(rep)), np.iinfo(perm.dtype).max
    xs, ys = [], []
    for s, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
        if e - s < 2:
            continue
        held = row[s:e]
        left = held[block[held] == i]
        right = left if i == j else held[block[held] == j]
        for start in range(0, len(left), 512):
            a = left[start : start + 512]
            near = near_pairs(vectors[a], vectors[right], threshold)
            if i == j:
                near &= a[:, None] < right[None, :]
            x, y = np.nonzero(near)
            x, y = a[x], right[y]
            for k in range(0, len(x), 100_000):
                p, r = perm[x[k : k + 100_000]], perm[y[k : k + 100_000]]
                common = np.sort(np.where((p[:, :, None] == r[:, None, :]).any(axis=2), p, top), axis=1)
                good = (common[:, 0] == pivot) & (common[:, 1] == q[s]) & (common[:, min(shared, common.shape[1]) - 1] < top)
                xs.append(x[k : k + 100_000][good])
                ys.append(y[k : k + 100_000][good])
            if sum(map(len, xs)) > 1_000_000:
                count, root, xs, ys = *_merged(count, root, xs, ys, mult), [], []
    count, root = _merged(count, root, xs, ys, mult)
    return pa.table({"rep": rep, "n": count, "to": rep[root]})


def _merged(count: np.ndarray, root: np.ndarray, xs: list[np.ndarray], ys: list[np.ndarray], mult: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``count`` and ``root`` with the links (xs, ys)."""
    n = len(count)
    x, y = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (xs, ys))
    count = count + np.bincount(x, weights=mult[y], minlength=n).astype(np.int64) + np.bincount(y, weights=mult[x], minlength=n).astype(np.int64)
    return count, _roots(n, np.concatenate([x, np.arange(n)]), np.concatenate([y, root]))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """(id, n_links bigint, component_id, kept boolean) for every row."""
    if shared < 2:
        raise ValueError("lists are of pairs of pivots")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("class", F.when(usable, F.sha2(F.array_join(F.transform("embedding", lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))), ","), 256)))
    classes = cut(rows.filter("class is not null").select("id", "class", "embedding").groupBy("class").agg(F.count_distinct("id").alias("mult"), F.min("id").alias("rep"), F.first("embedding").alias("embedding")))
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    count = pivot_count(n)
    # the sample is bounded by MAX_PIVOTS vectors
    sample = classes.filter(F.size("embedding") == dim).orderBy(F.xxhash64("class"), "class").limit(count).select("embedding").toArrow()
    pivots = _unit(_matrix(sample.column(0).combine_chunks()))
    take = min(prefix, len(pivots))

    def describe(batches):
        for b in batches:
            odd = np.array([len(x) != dim for x in b.column(2)])
            perm = np.full((b.num_rows, take), -1, np.int32)
            perm[:] = np.arange(-1, -take - 1, -1)
            if (~odd).any():
                even = b.column(2).filter(pa.array(~odd))
                unit, found = _unit(_matrix(even)), []
                for k in range(0, len(unit), 512):
                    far = -(unit[k : k + 512] @ pivots.T)
                    edge = np.partition(far, take - 1, axis=1)[:, take - 1 : take]
                    far[far > edge] = np.inf  # the nearest ones, and ties with the last of them
                    found.append(np.argsort(far, axis=1, kind="stable")[:, :take])
                perm[~odd] = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(perm.reshape(-1)), take).cast(pa.list_(pa.int32()))], ["rep", "mult", "embedding", "perm"])

    kind, id_kind = vectors.schema[vector_col].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    described = cut(classes.select("rep", "mult", "embedding").mapInArrow(describe, f"rep {id_kind}, mult bigint, embedding {kind}, perm array<int>"))
    # a vector of an odd length stands in one list of its length only
    odd, ascending = F.col("perm")[0] < 0, F.array_sort("perm")
    heads = described.withColumn("dim", F.size("embedding")).select("*", F.posexplode(F.slice(ascending, 1, F.when(odd, 1).otherwise(max(take - 1, 1)))).alias("at", "pivot"))
    heads = heads.withColumn("rest", F.slice(ascending, F.col("at") + 2, F.when(odd, 1).otherwise(take))).drop("at")
    sizes = cut(heads.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    # at most one row per pivot, and one per odd length
    posted = heads.join(F.broadcast(sizes), ["dim", "pivot"])
    sub = lambda x: F.pmod(F.pmod(x.cast("bigint") * SPREAD, F.lit(1 << 32)), F.col("parts"))
    posted = posted.withColumn("sub", F.explode(F.array_distinct(F.transform("rest", sub)))).drop("rest")
    lists = posted.groupBy("dim", "pivot", "sub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    posted = posted.join(small(cut(lists)), ["dim", "pivot", "sub"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    posted = posted.withColumn("o", other).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o", "blocks")
    found = posted.groupBy("dim", "pivot", "sub", "i", "j").applyInArrow(lambda t: linked_in_lists(t, threshold, shared), f"rep {id_kind}, n bigint, to {id_kind}")
    found = cut(found.filter("n > 0 or rep <> to"))
    component = connected_components(found.select("rep", "to"), "rep", "to").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    answer = classes.select("class", "rep", "mult").join(links, "rep", "left").join(component, "rep", "left")
    answer = answer.select("class", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", "class").join(answer, "class", "left").select("id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive ok as (
  select vec_id, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n
  from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and vec_id is not null
), links as materialized (
  select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0
  where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select v.vec_id, (select count(*) from links where a = v.vec_id)::bigint n_links,
  least(v.vec_id, coalesce((select min(b) from reach where a = v.vec_id), v.vec_id)) component_id,
  v.vec_id <= coalesce((select min(b) from reach where a = v.vec_id), v.vec_id) kept
from embeddings v
"""
