"""A Merkle manifest of a table: a root that stands for every row, and for each row the proof that it is under that root.

Rows are leaves. A leaf is the SHA-256 of its fields, each as ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Per group
(``group_col``) leaves ascend by (id, leaf), nulls first; while a group has several nodes, every ``ARITY`` consecutive ones (the last
run may have fewer, even one) become the hash of their digests as lower-case hex. What remains is the group's subroot, and the
subroots, ordered by group (null first, then bytewise), become the root in the same way.

``ARITY ** LEVELS`` consecutive leaves are an aligned block, and a block is one group of a grouped-map job: a postorder recursion
returns the digest of each subtree and, while it unwinds, appends the siblings of each subtree to the proofs of the leaves inside it.
The roots of the blocks are the leaves of the next distributed traversal, until a group has one node; the subroots go the same way.
So a task holds ``ARITY ** LEVELS`` rows whatever the table is, and there are log(rows) / log(4,096) jobs. Proofs above a block are
the same for all of its leaves and are joined to them once.

Nulls are fields like others; rows without an id stand first in their group. Texts of any length are hashed whole inside Spark's own
functions. Equal rows are equal leaves beside each other. An empty table gives no rows. Columns that are not named are not read, so they
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import cut

ARITY = 8
LEVELS = 4
BROADCAST_BLOCKS = 4_096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def leaf_hash(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of fields, each marked with its length so that no two rows run together."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def combined(digests: bytes) -> bytes:
    """The parent of digests that lie one behind the other."""
    return sha256(digests.hex().encode()).digest()


def subtree(leaves: list[bytes], height: int, arity: int = ARITY) -> tuple[bytes, list[bytes]]:
    """The root of consecutive ``leaves`` at ``height``, and for each leaf its siblings from the bottom up, left to right."""
    proofs: list[list[bytes]] = [[] for _ in leaves]

    def walk(first: int, end: int, height: int) -> bytes:
        if not height:
            return leaves[first]
        step = arity ** (height - 1)
        runs = [(at, min(at + step, end)) for at in range(first, end, step)]
        roots = [walk(a, b, height - 1) for a, b in runs]
        for k, (a, b) in enumerate(runs):
            others = b"".join(roots[:k] + roots[k + 1 :])
            for at in range(a, b):
                proofs[at].append(others)
        return combined(b"".join(roots))

    return walk(0, len(leaves), height), [b"".join(p) for p in proofs]


def height_of(nodes: int, arity: int = ARITY) -> int:
    """Levels above ``nodes`` nodes until one remains."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // arity), height + 1
    return height


def fold(leaf: bytes, proof: bytes, places: tuple[tuple[int, int], ...], arity: int = ARITY) -> bytes:
    """The root that ``leaf`` leads to with the siblings of ``proof``; ``places`` are (place, number of nodes) in its group and of its group."""
    node, at = leaf, 0
    for place, nodes in places:
        while nodes > 1:
            k = place % arity
            size = min(arity, nodes - place + k) - 1
            left, right = proof[at : at + DIGEST * k], proof[at + DIGEST * k : at + DIGEST * size]
            node = combined(left + node + right)
            at += DIGEST * size
            place, nodes = place // arity, -(-nodes // arity)
    return node


def _traversed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (grp, pos, nodes, digest, more columns) with ``siblings`` up to the root of their block, and that root as ``top`` on each block's first row."""
    block = arity**levels

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        count = t.column("nodes")[0].as_py()
        top, proofs = subtree(t.column("digest").to_pylist(), levels if count > block else height_of(count, arity), arity)
        t = t.drop_columns(["block"]).append_column("siblings", pa.array(proofs, pa.binary()))
        return t.append_column("top", pa.array([top] + [None] * (t.num_rows - 1), pa.binary()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    blocks = nodes.withColumn("block", F.expr(f"pos div {block}"))
    return cut(blocks.groupBy("grp", "block").applyInArrow(run, f"{kinds}, siblings binary, top binary"))


def _climbed(nodes: DataFrame, arity: int, levels: int) -> tuple[DataFrame, DataFrame, int]:
    """(the traversed nodes with a column ``block``; (grp, block, above, subroot) of each block; the number of blocks)."""
    block = arity**levels
    tables = [_traversed(nodes, arity, levels)]
    while True:
        tops = tables[-1].filter("top is not null").select("grp", F.expr(f"pos div {block}").alias("pos"), F.ceil(F.col("nodes") / block).cast("bigint").alias("nodes"), F.col("top").alias("digest"))
        if (tops.agg(F.max("nodes")).first()[0] or 0) <= 1:
            break
        tables.append(_traversed(tops, arity, levels))
    # from the top down: what is above each node of a traversal is what is above its block
    above = tops.select("grp", F.col("pos").alias("block"), F.lit(b"").alias("above"), F.col("digest").alias("subroot"))
    for t in tables[:0:-1]:
        inner = t.select("grp", F.col("pos").alias("at"), F.expr(f"pos div {block}").alias("block"), "siblings")
        above = inner.join(above, ["grp", "block"]).select("grp", F.col("at").alias("block"), F.concat("siblings", "above").alias("above"), "subroot")
    above = cut(above)
    return tables[0].drop("top").withColumn("block", F.expr(f"pos div {block}")), above, above.count()


def manifest(leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, claimed, grp, grps, pos, nodes, subroot, root, proof) from (id, part, leaf, claimed), all digests as binary.

    ``part`` is the group's value; ``grp`` of ``grps`` and ``pos`` of ``nodes`` are the places that ``fold`` takes; ``claimed`` is carried along.
    """
    rows = cut(leaves.select("id", "part", "leaf", "claimed").withColumn("turn", F.monotonically_increasing_id()))
    placed = global_rank(rows, [F.col("part"), F.col("id"), F.col("leaf"), F.col("turn")], "rank")
    parts = cut(placed.groupBy("part").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("nodes")))
    parts = cut(global_rank(parts, [F.col("part")], "grp").select(F.col("part").alias("part_"), "first", "nodes", "grp"))
    count = parts.count()
    parts_ = F.broadcast(parts) if count <= BROADCAST_BLOCKS else parts
    nodes = placed.join(parts_, F.col("part").eqNullSafe(F.col("part_"))).select("grp", (F.col("rank") - F.col("first")).alias("pos"), "nodes", F.col("leaf").alias("digest"), "id", "claimed")
    rows, above, blocks = _climbed(nodes, arity, levels)
    # the subroots are one more group
    roots = above.groupBy("grp").agg(F.first("subroot").alias("digest"))
    over, top, more = _climbed(roots.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("pos"), F.lit(count).cast("bigint").alias("nodes"), "digest"), arity, levels)
    top = top.select("block", F.col("above").alias("over"), F.col("subroot").alias("root"))
    over = over.join(F.broadcast(top) if more <= BROADCAST_BLOCKS else top, "block").select(F.col("pos").alias("grp"), F.concat("siblings", "over").alias("over"), "root")
    above = above.join(F.broadcast(over) if count <= BROADCAST_BLOCKS else over, "grp").select("grp", "block", F.concat("above", "over").alias("above"), "subroot", "root")
    found = rows.join(F.broadcast(above) if blocks <= BROADCAST_BLOCKS else above, ["grp", "block"])
    return found.select("id", F.col("digest").alias("leaf"), "claimed", "grp", F.lit(count).cast("bigint").alias("grps"), "pos", "nodes", "subroot", "root", F.concat("siblings", "above").alias("proof"))


def folded(proved: DataFrame, arity: int = ARITY) -> DataFrame:
    """``manifest``'s rows with ``folded``, the root that ``claimed`` leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("claimed", "proof", "pos", "nodes", "grp", "grps")]
            roots = [fold(leaf, proof, ((p, n), (g, m)), arity) for leaf, proof, p, n, g, m in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.binary())], [*b.schema.names, "folded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proved.schema)
    return proved.mapInArrow(run, f"{kinds}, folded binary")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_hash(*fields.values())
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_hash(*(fields | {"text": lowered}).values())
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), F.unhex(leaf).alias("leaf"), F.unhex(F.when(hit, tampered).otherwise(leaf)).alias("claimed"))
    text = lambda c: F.lower(F.hex(c))
    return folded(manifest(leaves)).select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


# crc32 of the bytes of a decimal number: each is mixed in, then shifted eight times
_EIGHT = "list_reduce([xor(a, b)::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, if(c & 1 = 1, 3988292384, 0)))"
_FIELD = "if({0} is null, '-', strlen({0}::varchar) || ':' || {0})"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in FIELDS) + ")"


SQL = f"""
with recursive hits as (
  select *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x))), lambda a, b: {_EIGHT}), 4294967295) % 3 = 0 hit from documents
), rows_ as materialized (
  select doc_id, lang, {_leaf_sql("text")} leaf, if(hit, {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, {_leaf_sql("text")}) claimed from hits
), placed as materialized (
  select *, dense_rank() over (order by lang nulls first) - 1 g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i from rows_
), tree(g, lvl, i, h, n) as (
  select g, 0, i, leaf, count(*) over (partition by g) from placed
  union all select g, lvl + 1, i // {ARITY}, sha256(string_agg(h, '' order by i)), any_value((n + {ARITY - 1}) // {ARITY}) from tree where n > 1 group by g, lvl, i // {ARITY}
), subroots as materialized (
  select g, h from tree where n = 1
), crown(lvl, i, h, n) as (
  select 0, g, h, count(*) over () from subroots
  union all select lvl + 1, i // {ARITY}, sha256(string_agg(h, '' order by i)), any_value((n + {ARITY - 1}) // {ARITY}) from crown where n > 1 group by lvl, i // {ARITY}
), nodes as materialized (
  select g, lvl, i, h, n from tree where n > 1 union all select p.g, 100 + lvl, c.i, c.h, c.n from (select distinct g from placed) p, crown c where c.n > 1
), steps as materialized (
  select doc_id, leaf, claimed, p.g, lvl, if(lvl < 100, p.i // (8 ** lvl)::bigint, p.g // (8 ** (lvl - 100))::bigint) spot
  from placed p join (select distinct g, lvl from nodes) l on l.g = p.g
), runs as materialized (
  select doc_id, leaf, claimed, s.lvl, coalesce(string_agg(h, '' order by i) filter (i < spot), '') lo, coalesce(string_agg(h, '' order by i) filter (i > spot), '') hi
  from steps s join nodes x on x.g = s.g and x.lvl = s.lvl and x.i // {ARITY} = s.spot // {ARITY} group by doc_id, leaf, claimed, s.lvl, spot
), turns as materialized (
  select *, row_number() over (partition by doc_id, leaf order by lvl) k from runs
), walk(doc_id, leaf, k, h) as (
  select doc_id, leaf, 0, claimed from placed union all select w.doc_id, w.leaf, w.k + 1, sha256(lo || h || hi) from walk w join turns t on t.doc_id is not distinct from w.doc_id and t.leaf = w.leaf and t.k = w.k + 1
)
select p.doc_id, p.leaf, s.h subroot, c.h root, sha256(coalesce((select string_agg(lo || hi, '' order by k) from turns t where t.doc_id = p.doc_id and t.leaf = p.leaf), '')) proof_sha256,
  w.h folded_root, w.h = c.h verified
from placed p join subroots s on s.g = p.g join (select h from crown where n = 1) c on true
join (select doc_id, leaf, arg_max(h, k) h from walk group by doc_id, leaf) w on w.doc_id = p.doc_id and w.leaf = p.leaf
"""
