"""Named queries over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwave.control import decomposition_charges, outcome, schedule_charges
from arcwave.graph import FORWARD, REVERSE, Graph, fingerprint
from arcwave.functions import tables as table_functions
from arcwave.operators import bands, colours
from arcwave.operators.schedule import Schedule, longest_paths
from arcwave.operators.scc import Decomposition, decompose, regrouped
from arcwave.operators.traversal import breadth_first, depth_first, depth_first_forest, levels_from
from arcwave.plans.lineage import cut, shared_dir
from arcwave.sources import datasource, parts, snapshot, tables
from arcwave.streaming import merging

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PROFILE = bytes(range(32))
LIMITS = (0, 1, 5_000, 30_000, 60_000, 1_000_000)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# The graphs in SQL: v(k, dense) and e(src, dst), then what components and ranks need.

_LINES = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount"
_RAW = {
    "copart": ("select p_partkey k from part", f"select s, t from (select l_partkey s, lead(l_partkey) over ({_LINES}) t, l_quantity q from lineitem) where q >= 48"),
    "cosupp": ("select s_suppkey k from supplier", f"select s, t from (select l_suppkey s, lead(l_suppkey) over ({_LINES}) t, l_quantity q, l_discount d from lineitem) where q >= 50 and d >= 0.09"),
    "handoff": ("select c_custkey k from customer", "select s, t from (select o_custkey s, lead(o_custkey) over (order by o_orderdate, o_orderkey) t, o_orderpriority p, o_orderstatus st from orders) where p = '1-URGENT' and st = 'F'"),
    "copart_whole": ("select p_partkey k from part", f"select l_partkey s, lead(l_partkey) over ({_LINES}) t from lineitem"),
    "cosupp_whole": ("select s_suppkey k from supplier", f"select l_suppkey s, lead(l_suppkey) over ({_LINES}) t from lineitem"),
    "handoff_whole": ("select c_custkey k from customer", "select o_custkey s, lead(o_custkey) over (order by o_orderdate, o_orderkey) t from orders"),
    "dialogue": ("select printf('%019d:%019d', conv_id, turn) k from conversations", "select printf('%019d:%019d', conv_id, turn) s, lead(printf('%019d:%019d', conv_id, turn)) over (partition by conv_id order by turn) t from conversations"),
    "journeys": ("select user_id || ':' || event_type k from events", "select user_id || ':' || event_type s, lead(user_id || ':' || event_type) over (partition by user_id order by ts, event_id) t from events"),
    "event_types": ("select event_type k from events", "select event_type s, lead(event_type) over (partition by user_id order by ts, event_id) t from events"),
}


def with_graph(name: str, body: str, more: str = "") -> str:
    nodes, pairs = _RAW[name]
    return f"""with recursive v as materialized (select k, (row_number() over (order by k) - 1)::bigint dense from (select distinct k from ({nodes}))),
raw as materialized (select s, t from ({pairs}) where t is not null),
e as materialized (select distinct a.dense src, b.dense dst from raw join v a on a.k = s join v b on b.k = t){more}
{body}"""


_SCC = """,
reach(a, b) as (select src, dst from e union select r.a, e.dst from reach r join e on e.src = r.b),
least as materialized (select v.dense, least(v.dense, coalesce((select min(x.b) from reach x join reach y on y.a = x.b and y.b = x.a where x.a = v.dense), v.dense)) m from v),
mem as materialized (select dense, (dense_rank() over (order by m) - 1)::bigint component from least),
loops as (select distinct m.component from e join mem m on m.dense = e.src where e.src = e.dst),
comp as materialized (
  select component, (sum(n) over (order by component) - n)::bigint member_start, (sum(n) over (order by component))::bigint member_end, n::bigint member_count,
    n > 1 or l is not null cyclic, n = 1 and l is not null self_cycle, n > 1 multi_vertex_cycle
  from (select mem.component, count(*) n, any_value(loops.component) l from mem left join loops on loops.component = mem.component group by mem.component)),
cand as materialized (select a.component cs, b.component cd from e join mem a on a.dense = src join mem b on b.dense = dst where a.component <> b.component),
q as materialized (select distinct cs src, cd dst from cand)"""
_RANK = (
    _SCC
    + """,
deep(c, d) as (select component, 0::bigint from comp union select q.dst, d + 1 from deep join q on q.src = deep.c),
ranks as materialized (select c component, max(d) as rank from deep group by c)"""
)
_DIMS = "(select count(*) from v) nv, (select count(*) from e) ne, (select count(*) from comp) nc, (select count(*) from cand) nr, (select count(*) from q) nq"


def _build(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return tables.graph(getattr(tables, name)(spark, sf_dir))


def _decomposed(spark: SparkSession, sf_dir: str, name: str) -> Decomposition:
    return decompose(_build(spark, sf_dir, name))


def _scheduled(spark: SparkSession, sf_dir: str, name: str) -> tuple[Decomposition, Schedule]:
    d = _decomposed(spark, sf_dir, name)
    return d, d.condensation.schedule()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the co-purchase graph with their ranks."""
    d, s = _scheduled(spark, sf_dir, "copart")
    return d.components.join(s.table.select("component", "rank"), "component").select("component", "member_count", "cyclic", "rank")


query("components_with_ranks", with_graph("copart", "select comp.component, member_count, cyclic, rank from comp join ranks on ranks.component = comp.component", _RANK))(flagship)

# construction and projections
for _name in _RAW:
    query(f"canonical_vertices_{_name}", with_graph(_name, "select dense, k as stable from v"))(lambda spark, sf_dir, n=_name: _build(spark, sf_dir, n).vertices)
    query(f"canonical_edges_{_name}", with_graph(_name, "select src, dst from e"))(lambda spark, sf_dir, n=_name: _build(spark, sf_dir, n).edges)
    query(f"graph_dimensions_{_name}", with_graph(_name, "select (select count(*) from v) vertex_count, (select count(*) from raw) raw_edges, (select count(*) from e) edge_count, (select count(*) from e where src = dst) self_loops"))(
        lambda spark, sf_dir, n=_name: _dimensions(spark, sf_dir, n)
    )


def _dimensions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    g = _build(spark, sf_dir, name)
    raw = getattr(tables, name)(spark, sf_dir)[1].agg(F.count(F.lit(1)).alias("raw_edges"))
    loops = g.edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    return raw.join(loops).select(F.lit(g.vertex_count).cast("bigint").alias("vertex_count"), "raw_edges", F.lit(g.edge_count).cast("bigint").alias("edge_count"), "self_loops")


@query("dense_edges", "select distinct l_partkey % 100 src, l_suppkey % 100 dst from lineitem")
def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Graph.from_dense_edges(spark, 100, lines.select((F.col("l_partkey") % 100).alias("src"), (F.col("l_suppkey") % 100).alias("dst"))).edges


def _offsets_sql(a: str) -> str:
    return with_graph("copart", f"""select 0::bigint pos, 0::bigint "offset" union all
select dense + 1, (sum(n) over (order by dense))::bigint from (select dense, (select count(*) from e where {a} = dense) n from v)""")  # fmt: skip


query("csr_forward_offsets", _offsets_sql("src"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart").offsets(FORWARD))
query("csr_reverse_offsets", _offsets_sql("dst"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart").offsets(REVERSE))
query("csr_forward_targets", with_graph("copart", "select (row_number() over (order by src, dst) - 1)::bigint pos, dst target from e"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart").targets(FORWARD))
query("csr_reverse_targets", with_graph("copart", "select (row_number() over (order by dst, src) - 1)::bigint pos, src target from e"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart").targets(REVERSE))
query("adjacency_lists", with_graph("copart", "select src, dst, (row_number() over (partition by src order by dst) - 1)::bigint pos from e"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart").adjacency())
query("predecessor_lists", with_graph("copart", "select dst src, src dst, (row_number() over (partition by dst order by src) - 1)::bigint pos from e"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart").adjacency(REVERSE))
query("successors_of", with_graph("copart_whole", "select dst from e where src = 7"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart_whole").indexed().successors(7))
query("predecessors_of", with_graph("copart_whole", "select src from e where dst = 7"))(lambda spark, sf_dir: _build(spark, sf_dir, "copart_whole").indexed().predecessors(7))


@query("stable_lookup", with_graph("cosupp", "select (select k from v where dense = 7) as stable, (select dense from v where k = (select k from v where dense = 7)) dense, exists (select 1 from e where src = 7 and dst = 8) has_edge"))
def stable_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _build(spark, sf_dir, "cosupp")
    key = g.stable_id(7)
    return spark.createDataFrame([(key, g.dense_id(key), g.contains_edge(7, 8))], "stable bigint, dense bigint, has_edge boolean")


# traversals
@query("bfs_order", with_graph("copart", "select (row_number() over (order by lvl, p) - 1)::bigint pos, v as dense from walk", """,
walk(v, lvl, p) using key (v) as (
  select 0::bigint, 0::bigint, 0::bigint union
  select dst, lvl, (row_number() over (order by mp, dst) - 1)::bigint from (
    select e.dst, max(w.lvl) + 1 lvl, min(w.p) mp from walk w join e on e.src = w.v where not exists (select 1 from recurring.walk r where r.v = e.dst) group by e.dst))"""))  # fmt: skip
def bfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breadth_first(_build(spark, sf_dir, "copart"), 0)


@query("bfs_levels", with_graph("copart", "select (row_number() over (order by lvl, p) - 1)::bigint pos, v as dense from walk", """,
walk(v, lvl, p) using key (v) as (
  select 0::bigint, 0::bigint, 0::bigint union
  select dst, lvl, (row_number() over (order by mp, dst) - 1)::bigint from (
    select e.dst, max(w.lvl) + 1 lvl, min(w.p) mp from walk w join e on e.src = w.v where not exists (select 1 from recurring.walk r where r.v = e.dst) group by e.dst))"""))  # fmt: skip
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breadth_first(_build(spark, sf_dir, "copart"), 0, strategy="distributed")


query("bfs_levels_whole", with_graph("copart_whole", "select lvl::bigint as level, v as dense from walk", """,
walk(v, lvl) using key (v) as (
  select 0::bigint, 0 union select e.dst, max(w.lvl) + 1 from walk w join e on e.src = w.v where not exists (select 1 from recurring.walk r where r.v = e.dst) group by e.dst)"""))(lambda spark, sf_dir: levels_from(_build(spark, sf_dir, "copart_whole"), 0)[0].select("level", "dense"))  # fmt: skip
query("reachable_set", with_graph("copart", "select b as dense from reach", ", reach(b) as (select 0::bigint union select dst from reach join e on src = b)"))(lambda spark, sf_dir: breadth_first(_build(spark, sf_dir, "copart"), 0).select("dense"))

def _stack_sql(body: str, start: str, step: str) -> str:
    """A depth-first walk in SQL: one row a turn with its stack and the vertices that were pushed; ``step`` gives (pos, v, root, rest, seen) of a turn."""
    return with_graph("copart", body, f""",
adj as materialized (select src, list(dst order by dst desc) out from e group by src),
walk(pos, v, root, stack, seen) as (
  {start} union all
  select pos, v, root, rest || fresh, list_transform(seen, lambda x, i: x or list_contains(fresh, i - 1)) from (
    select t.*, list_filter(coalesce(a.out, []::bigint[]), lambda w: not t.seen[w + 1]) fresh from ({step}) t left join adj a on a.src = t.v))""")


_FLAGS = "(select list(dense = {0} order by dense) from v)"
_POP = "select pos + 1 pos, list_last(stack) v, root, list_slice(stack, 1, -2) rest, seen from walk where len(stack) > 0"
_NEXT = """select pos + 1 pos, list_position(seen, false) - 1 v, list_position(seen, false) - 1 root, []::bigint[] rest, list_transform(seen, lambda x, i: x or i = list_position(seen, false)) seen
from walk where len(stack) = 0 and list_contains(seen, false)"""
query("dfs_preorder", _stack_sql("select pos::bigint pos, v::bigint dense from walk where pos >= 0", f"select -1::bigint, -1::bigint, 0::bigint, [0::bigint], {_FLAGS.format(0)}", _POP))(lambda spark, sf_dir: depth_first(_build(spark, sf_dir, "copart"), 0))
query("dfs_forest", _stack_sql("select pos::bigint pos, root::bigint root, v::bigint dense from walk where pos >= 0", f"select -1::bigint, -1::bigint, -1::bigint, []::bigint[], {_FLAGS.format(-1)}", f"{_POP} union all {_NEXT}"))(
    lambda spark, sf_dir: depth_first_forest(_build(spark, sf_dir, "copart"))
)

# components and their quotient
for _name in ("copart", "cosupp", "handoff", "event_types", "copart_whole", "cosupp_whole", "handoff_whole", "journeys"):
    query(f"scc_membership_{_name}", with_graph(_name, "select dense, component from mem", _SCC))(lambda spark, sf_dir, n=_name: _decomposed(spark, sf_dir, n).membership)
    query(f"scc_components_{_name}", with_graph(_name, "select * from comp", _SCC))(lambda spark, sf_dir, n=_name: _decomposed(spark, sf_dir, n).components)
query("scc_membership_distributed", with_graph("copart", "select dense, component from mem", _SCC))(lambda spark, sf_dir: decompose(_build(spark, sf_dir, "copart"), "distributed").membership)
for _name in ("copart_whole", "journeys"):
    query(f"scc_membership_{_name}_joins", with_graph(_name, "select dense, component from mem", _SCC))(lambda spark, sf_dir, n=_name: decompose(_build(spark, sf_dir, n), "distributed").membership)
query("scc_fibers", with_graph("copart", "select (row_number() over (order by component, dense) - 1)::bigint pos, component, dense from mem", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "copart").fibers())
query("scc_cyclic", with_graph("cosupp", "select component, member_count, self_cycle from comp where cyclic", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "cosupp").cyclic_components().select("component", "member_count", "self_cycle"))
query("scc_is_acyclic", with_graph("dialogue", "select not exists (select 1 from comp where cyclic) acyclic", _SCC))(lambda spark, sf_dir: spark.createDataFrame([(_decomposed(spark, sf_dir, "dialogue").is_acyclic(),)], "acyclic boolean"))
query("scc_fiber_of", with_graph("copart", "select dense from mem where component = (select component from mem where dense = 3)", _SCC))(lambda spark, sf_dir: (lambda d: d.fiber(d.component_of(3)))(_decomposed(spark, sf_dir, "copart")))
query("scc_validate_report", "select unnest(['total', 'in domain', 'fibers contiguous', 'fiber sizes', 'order by least member', 'cycle flags', 'quotient complete', 'quotient sound', 'strongly connected']) law, 0::bigint broken")(lambda spark, sf_dir: _decomposed(spark, sf_dir, "cosupp").violations())


# decompositions that are broken on purpose: what the checks find
def _law_counts(counts: dict[str, str]) -> str:
    laws = ("total", "in domain", "fibers contiguous", "fiber sizes", "order by least member", "cycle flags", "quotient complete", "quotient sound", "strongly connected")
    return " union all ".join(f"select '{law}' law, ({counts.get(law, 'select 0')})::bigint broken" for law in laws)


@query("scc_merged_report", with_graph("cosupp", _law_counts({"strongly connected": "select count(distinct g) from pairs where not linked"}), _SCC + """,
grp as materialized (select dense, component // 2 g from mem),
held as materialized (select a.g, src, dst from e join grp a on a.dense = src join grp b on b.dense = dst where a.g = b.g),
inside(g, a, b) as (select g, src, dst from held union select i.g, i.a, h.dst from inside i join held h on h.g = i.g and h.src = i.b),
pairs as materialized (select x.g, exists (select 1 from inside i where i.a = x.dense and i.b = y.dense) linked from grp x join grp y on x.g = y.g and x.dense <> y.dense)"""))  # fmt: skip
def scc_merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two neighbouring components taken for one, all tables made to fit: only strong connectivity fails."""
    d = _decomposed(spark, sf_dir, "cosupp")
    return regrouped(d, d.membership.select("dense", F.expr("component div 2").alias("component"))).violations()


@query("scc_broken_report", with_graph("cosupp", _law_counts({
    "fibers contiguous": "select count(*) from comp where component > 0 and (component - 1) % 5 = 0", "fiber sizes": "select count(*) from comp where component % 5 = 0",
    "cycle flags": "select count(*) from comp where component % 3 = 0", "quotient complete": "select count(*) from q where (src + dst) % 4 = 0",
}), _SCC))
def scc_broken_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of ranges, cycle flags and edges of the quotient changed by rule."""
    d = _decomposed(spark, sf_dir, "cosupp")
    c = d.components.withColumn("member_end", F.col("member_end") + (F.col("component") % 5 == 0).cast("int")).withColumn("cyclic", F.col("cyclic") != (F.col("component") % 3 == 0))
    return replace(d, components=c, condensation=replace(d.condensation, edges=d.condensation.edges.filter("(src + dst) % 4 <> 0"))).violations()


query("condensation_edges", with_graph("copart", "select src, dst from q", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "copart").condensation.edges)
query("condensation_successors", with_graph("cosupp", "select dst from q where src = 5", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "cosupp").condensation.successors(5))
query("condensation_predecessors", with_graph("cosupp", "select src from q where dst = 5", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "cosupp").condensation.predecessors(5))
query("condensation_reverse", with_graph("copart", "select dst src, src dst from q", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "copart").condensation.transposed())


@query("condensation_dimensions", with_graph("copart", f"select nc component_count, nr candidates, nq edge_count from (select {_DIMS})", _SCC))
def condensation_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _decomposed(spark, sf_dir, "copart").profile
    return spark.createDataFrame([(p.component_count, p.quotient_candidate_count, p.quotient_edge_count)], "component_count bigint, candidates bigint, edge_count bigint")


# schedules
_TOPO = """,
turn(c, r, p) as (
  select component, 0::bigint, (row_number() over (order by component) - 1)::bigint from ranks where rank = 0 union all
  select dst, r, ((select count(*) from ranks where rank < r) + row_number() over (order by mp, dst) - 1)::bigint from (
    select q.dst, max(t.r) + 1 r, max(t.p) mp from turn t join q on q.src = t.c join ranks k on k.component = q.dst where k.rank = t.r + 1 group by q.dst))"""
for _name in ("copart", "cosupp", "copart_whole", "handoff_whole", "journeys", "dialogue"):
    query(f"ranks_{_name}", with_graph(_name, "select component, rank from ranks", _RANK))(lambda spark, sf_dir, n=_name: _scheduled(spark, sf_dir, n)[1].table.select("component", "rank"))
    query(f"topological_order_{_name}", with_graph(_name, "select p topo_pos, c component from turn", _RANK + _TOPO))(lambda spark, sf_dir, n=_name: _scheduled(spark, sf_dir, n)[1].table.select("topo_pos", "component"))
query("topological_order_distributed", with_graph("cosupp", "select p topo_pos, c component from turn", _RANK + _TOPO))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "cosupp").condensation.schedule("distributed").table.select("topo_pos", "component"))
for _name in ("journeys", "dialogue"):
    query(f"schedule_{_name}_joins", with_graph(_name, "select p topo_pos, c component, r as rank from turn", _RANK + _TOPO))(
        lambda spark, sf_dir, n=_name: decompose(_build(spark, sf_dir, n), "distributed").condensation.schedule("distributed").table.select("topo_pos", "component", "rank")
    )
query("waves", with_graph("copart", "select rank wave, (sum(n) over (order by rank) - n)::bigint wave_start, (sum(n) over (order by rank))::bigint wave_end, n size from (select rank, count(*) n from ranks group by rank)", _RANK))(lambda spark, sf_dir: _scheduled(spark, sf_dir, "copart")[1].waves())
query("wave_members", with_graph("copart", "select (row_number() over (order by rank, component) - 1)::bigint wave_pos, component from ranks", _RANK))(lambda spark, sf_dir: _scheduled(spark, sf_dir, "copart")[1].table.select("wave_pos", "component"))
query("wave_offsets", with_graph("copart", 'select 0::bigint pos, 0::bigint "offset" union all select rank + 1, (sum(n) over (order by rank))::bigint from (select rank, count(*) n from ranks group by rank)', _RANK))(lambda spark, sf_dir: _scheduled(spark, sf_dir, "copart")[1].wave_offsets())
query("schedule_work", with_graph("copart", f"select 6 * nc + nq + 3 * (max_rank + 1) + 1 logical_work, max_rank + 1 wave_count from (select {_DIMS}, (select max(rank) from ranks) max_rank)", _RANK))(
    lambda spark, sf_dir: (lambda s: spark.createDataFrame([(s.logical_work, s.wave_count)], "logical_work bigint, wave_count bigint"))(_scheduled(spark, sf_dir, "copart")[1])
)


@query("evaluate_waves_demo", with_graph("cosupp", "select c component, max(w) as value from pathw group by c", _RANK + """,
pathw(c, w) as (select component, component % 7 + 1 from comp union select q.dst, w + q.dst % 7 + 1 from pathw join q on q.src = pathw.c)"""))  # fmt: skip
def evaluate_waves_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _scheduled(spark, sf_dir, "cosupp")
    return longest_paths(d.condensation, s, d.components.select("component", (F.col("component") % 7 + 1).alias("weight")))


_LEDGER = """with v as (select o_orderkey k, (row_number() over (order by o_orderkey) - 1)::bigint component, (row_number() over (order by o_orderdate, o_orderkey) - 1)::bigint p from orders)"""


@query("schedule_ledger_joins", f"{_LEDGER} select component, p as rank, p topo_pos, p wave_pos from v")
def schedule_ledger_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many ranks as orders, found by joins."""
    return decompose(_build(spark, sf_dir, "ledger"), "distributed").condensation.schedule("distributed").table


@query("evaluate_bands_ledger", f"{_LEDGER} select component, (sum(k % 7 + 1) over (order by p))::bigint as value from v")
def evaluate_bands_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one component at a time over as many waves as orders, in a job for each half million of them."""
    d = _decomposed(spark, sf_dir, "ledger")
    payload = d.membership.join(d.graph.vertices, "dense").select("component", (F.col("stable") % 7 + 1).alias("weight"))
    return bands.evaluate(d.condensation, d.condensation.schedule(), payload, lambda c, own, seen: own["weight"] + max((x for _, x in seen), default=0), "bigint")[0]


@query("evaluate_bands_copart", with_graph("copart", "select c component, max(w) as value from pathw group by c", _RANK + """,
pathw(c, w) as (select component, component % 7 + 1 from comp union select q.dst, w + q.dst % 7 + 1 from pathw join q on q.src = pathw.c)"""))  # fmt: skip
def evaluate_bands_copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over waves of many sizes, with bands that a wave may fill alone."""
    d, s = _scheduled(spark, sf_dir, "copart")
    weights = d.components.select("component", (F.col("component") % 7 + 1).alias("weight"))
    return bands.evaluate(d.condensation, s, weights, lambda c, own, seen: own["weight"] + max((x for _, x in seen), default=0), "bigint", 200)[0]


# SQL alone
_JOURNEYS_SQL = """SELECT part, vertex, least, cyclic FROM graph_components(TABLE(
  SELECT user_id AS part, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM parquet.`{0}/events.parquet`
) PARTITION BY part)"""
_TURNS_SQL = """SELECT part, vertex, rank FROM graph_ranks(TABLE(
  SELECT conv_id AS part, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM parquet.`{0}/conversations.parquet`
) PARTITION BY part)"""


@query("sql_components", """with recursive e as materialized (select distinct user_id u, event_type s, lead(event_type) over (partition by user_id order by ts, event_id) t from events),
reach(u, a, b) as (select u, s, t from e where t is not null union select r.u, r.a, e.t from reach r join e on e.u = r.u and e.s = r.b where e.t is not null),
v as (select distinct u, s from e),
m as (select v.u, v.s, (select min(x.b) from reach x join reach y on y.u = x.u and y.a = x.b and y.b = x.a where x.u = v.u and x.a = v.s) l from v)
select u::varchar part, s vertex, least(s, coalesce(l, s)) "least", l is not null cyclic from m""")  # fmt: skip
def sql_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql(_JOURNEYS_SQL.format(sf_dir))


@query("sql_ranks", "select conv_id::varchar part, turn::varchar vertex, (row_number() over (partition by conv_id order by turn) - 1)::bigint as rank from conversations")
def sql_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql(_TURNS_SQL.format(sf_dir))


# streams
@query("stream_components", """with recursive l as (select l_suppkey part, l_orderkey a, -1 - l_partkey b from lineitem),
pairs as materialized (select part, a, b from l union select part, b, a from l),
walk(part, v, m) using key (part, v) as (
  select distinct part, a, a from pairs union
  select p.part, p.b, min(w.m) from walk w join pairs p on p.part = w.part and p.a = w.v join recurring.walk r on r.part = p.part and r.v = p.b where w.m < r.m group by p.part, p.b)
select part, v vertex, m component, count(*) over (partition by part, m) size from walk""")  # fmt: skip
def stream_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts that hang together by a supplier's lines, which come in four batches of a stream."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("part"), F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    for k in range(4):
        lines.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(4)) == k).write.mode("append").parquet(f"{folder}/in/turn={k}")
    arrived = spark.read.parquet(f"{folder}/in")
    files = max(1, -(-len(arrived.inputFiles()) // 4))
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in").select("part", "src", "dst")
    merging.keep(stream, f"{folder}/changes", f"{folder}/state", once=True).awaitTermination()
    return merging.labels(spark.read.parquet(f"{folder}/changes"))


# work
query("work_profile", with_graph("copart", f"""select nv vertex_count, ne edge_count, nc component_count, nr quotient_candidate_count, nq quotient_edge_count,
nv root_checks, nv discoveries, ne edge_inspections, nv frame_finishes, nv active_pops, nv canonical_assignments,
5 * nv + ne tarjan_work, 10 * nv + ne + 3 * nc + 1 partition_work, if(nr < 2, 0, 14 * nr + 13 * 2048) radix_work, 5 * nc + 3 * nq + 2 condensation_work,
10 * nv + ne + 3 * nc + 1 + ne + if(nr < 2, 0, 14 * nr + 13 * 2048) + 5 * nc + 3 * nq + 2 decomposition_work,
5 * nv + nc tarjan_slots_bound, 5 * nv + 2 * nc + 2 * nr + 2048 decomposition_slots_bound, 5 * nv + 4 * nc + 2 * nr + 2048 pipeline_slots_bound from (select {_DIMS})""", _SCC))(lambda spark, sf_dir: _decomposed(spark, sf_dir, "copart").profile.frame(spark))  # fmt: skip


@query("budget_outcomes", with_graph("copart", f"""select l.lim as work_limit, 10 * nv + 2 * ne + 8 * nc + 3 * nq + 3 + if(nr < 2, 0, 14 * nr + 13 * 2048) <= l.lim decomposed, 6 * nc + nq + 3 * (max_rank + 1) + 1 <= l.lim scheduled
from (select unnest({list(LIMITS)})::bigint lim) l, (select {_DIMS}, (select max(rank) from ranks) max_rank)""", _RANK))  # fmt: skip
def budget_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _scheduled(spark, sf_dir, "copart")
    rows = [(n, outcome(decomposition_charges(*d.profile.counts), n)[0], outcome(schedule_charges(s.component_count, s.edge_count, s.wave_count), n)[0]) for n in LIMITS]
    return spark.createDataFrame(rows, "work_limit bigint, decomposed boolean, scheduled boolean")


# snapshots
_LE = "substr(printf('%08x', {0}), 7, 2) || substr(printf('%08x', {0}), 5, 2) || substr(printf('%08x', {0}), 3, 2) || substr(printf('%08x', {0}), 1, 2)"
_WORDS = """, words as (select 0::bigint p, 0::bigint w union all select dense + 1, (sum(n) over (order by dense))::bigint from (select dense, (select count(*) from e where src = dense) n from v)
union all select (select count(*) from v) + row_number() over (order by src, dst), dst from e)"""


@query("snapshot_bytes_hex", with_graph("cosupp", f"""select '4c5647534e500001' || '4c5647492d4353522d4657442d563121' || '01000000' || '00000000' || '{PROFILE.hex()}'
|| (select {_LE.format("count(*)")} from v) || (select {_LE.format("count(*)")} from e) || (select {_LE.format("(4 * count(*))")} from words) || '00000000'
|| (select string_agg({_LE.format("w")}, '' order by p) from words) as hex""", _WORDS))  # fmt: skip
def snapshot_bytes_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(snapshot.encode_snapshot(_build(spark, sf_dir, "cosupp"), PROFILE).hex(),)], "hex string")


@query("snapshot_decode_edges", with_graph("cosupp", "select src, dst from e"))
def snapshot_decode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.decode_snapshot(spark, snapshot.encode_snapshot(_build(spark, sf_dir, "cosupp"), PROFILE), PROFILE).edges


@query("snapshot_chunks_decoded", with_graph("copart_whole", "select src, dst from e"))
def snapshot_chunks_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as chunks and read back from them, without a value of all bytes."""
    return snapshot.decode_chunks(cut(snapshot.snapshot_chunks(_build(spark, sf_dir, "copart_whole"), PROFILE)), PROFILE).edges


@query("snapshot_source_edges", with_graph("copart_whole", "select src, dst from e"))
def snapshot_source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read as a Spark data source, in byte ranges."""
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    datasource.write_snapshot(_build(spark, sf_dir, "copart_whole"), path, PROFILE)
    return datasource.read_snapshot(spark, path, PROFILE, bytes_a_task=1 << 16).edges


@query("snapshot_verified_edges", with_graph("cosupp", "select src, dst from e"))
def snapshot_verified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = snapshot.encode_snapshot(_build(spark, sf_dir, "cosupp"), PROFILE)
    return snapshot.decode_verified_snapshot(spark, data, PROFILE, snapshot.digest_snapshot(data, PROFILE, "queries"), "queries").edges


@query("snapshot_verified_chunks", with_graph("copart_whole", "select src, dst from e"))
def snapshot_verified_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from chunks whose digest, taken in tasks, is that of the same bytes in chunks of another size."""
    g = _build(spark, sf_dir, "copart_whole")
    mark = snapshot.digest_chunks(cut(snapshot.snapshot_chunks(g, PROFILE, 10_000)), PROFILE, "queries", part_chunks=64)
    return snapshot.decode_verified_chunks(cut(snapshot.snapshot_chunks(g, PROFILE)), PROFILE, mark, "queries").edges


@query("snapshot_migrated_edges", with_graph("handoff_whole", "select src, dst from e"))
def snapshot_migrated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one profile, migrated through the validated graph to another, and read under that."""
    other = PROFILE[::-1]
    old = cut(snapshot.snapshot_chunks(_build(spark, sf_dir, "handoff_whole"), PROFILE))
    return snapshot.decode_chunks(cut(snapshot.migrate_chunks(old, PROFILE, other)), other).edges


@query("import_parts", with_graph("copart_whole", "select src, dst from e"))
def import_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's own rows, both directions, imported with all checks."""
    g = _build(spark, sf_dir, "copart_whole")
    nodes = g.vertices.select(F.col("dense").alias("pos"), "stable")
    return parts.from_parts(nodes, parts.Rows(g.offsets(FORWARD), g.targets(FORWARD)), parts.Rows(g.offsets(REVERSE), g.targets(REVERSE))).edges


@query("snapshot_length", with_graph("copart", "select 80 + 4 * (nv + 1 + ne) snapshot_bytes, 10 + 4 * nv + 3 * ne decode_work_bound, 2 * nv + 1 + ne decode_heap_words from (select (select count(*) from v) nv, (select count(*) from e) ne)"))
def snapshot_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _build(spark, sf_dir, "copart")
    n = (g.vertex_count, g.edge_count)
    return spark.createDataFrame([(snapshot.snapshot_length(*n), snapshot.decode_work_bound(*n), snapshot.decode_heap_words(*n))], "snapshot_bytes bigint, decode_work_bound bigint, decode_heap_words bigint")


# laws
@query("renamed_graph", with_graph("cosupp", "select r.n src, s.n dst from e join ren r on r.dense = src join ren s on s.dense = dst", ", ren as (select dense, (select count(*) from v) - 1 - dense n from v)"))
def renamed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys negated: dense ids run the other way."""
    g = _build(spark, sf_dir, "cosupp")
    return g.renamed(g.vertices.select("stable", (-F.col("stable")).alias("name"))).edges


def _wl_sql(rounds: int) -> str:
    mark = "('0x' || substr(md5(c), 1, 15))::bigint"
    steps = [", w0 as materialized (select dense, '' c from v)"]
    for k in range(rounds):
        side = lambda own, other: f"(select {own} dense, sum({mark})::varchar s from e join w{k} on w{k}.dense = {other} group by {own})"  # noqa: E731, B023
        steps.append(f""", w{k + 1} as materialized (select w{k}.dense, md5(c || '|' || coalesce(o.s, '0') || '|' || coalesce(i.s, '0')) c
from w{k} left join {side("src", "dst")} o on o.dense = w{k}.dense left join {side("dst", "src")} i on i.dense = w{k}.dense)""")
    return "".join(steps)


@query("colours_renamed", with_graph("cosupp_whole", f"select c colour, count(*) n from w{colours.ROUNDS} group by c", _wl_sql(colours.ROUNDS)))
def colours_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of the renamed graph; the SQL refines the graph under its first names."""
    g = _build(spark, sf_dir, "cosupp_whole")
    return colours.histogram(g.renamed(g.vertices.select("stable", F.sha2(F.col("stable").cast("string"), 256).alias("name"))))


@query("components_renamed", with_graph("copart", "select component, (dense_rank() over (order by max(dense) desc) - 1)::bigint renamed, count(*) n from mem group by component", _SCC))
def components_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys negated: the bijection between the components of both graphs, with the members that are in both."""
    g = _build(spark, sf_dir, "copart")
    mapping = g.vertices.select("stable", (-F.col("stable")).alias("name"))
    return colours.induced(decompose(g), decompose(g.renamed(mapping)), mapping)


_PRINT = """select '{0}' part, count(*) n, coalesce(sum(('0x' || substr(m, 1, 15))::bigint), 0)::varchar low, coalesce(sum(('0x' || substr(m, 16, 15))::bigint), 0)::varchar high from (select md5({1}) m from {2})"""


@query("enumeration_invariance", with_graph("cosupp", _PRINT.format("vertices", "dense || ',' || k", "v") + " union all " + _PRINT.format("edges", "src || ',' || dst", "e")))
def enumeration_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the graph of shuffled and repeated inputs."""
    nodes, pairs = tables.cosupp(spark, sf_dir)
    shuffled = Graph.from_edges(nodes.unionByName(nodes).orderBy(F.desc("k")), pairs.unionByName(pairs).orderBy(F.xxhash64("s", "t")))
    return shuffled.fingerprints()


@query("mirror_fingerprints", with_graph("copart_whole", _PRINT.format("forward", "src || ',' || dst", "e") + " union all " + _PRINT.format("backward", "dst || ',' || src", "e")))
def mirror_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of both directions as compressed rows give them."""
    g = _build(spark, sf_dir, "copart_whole")
    back = parts.Rows(g.offsets(REVERSE), g.targets(REVERSE)).edges()
    return fingerprint(g.edges, "forward").unionByName(fingerprint(back.select("src", "dst"), "backward"))


_EVIDENCE = ("protected_signer", "protected_head", "gates_passed", "portable_tool_closure", "formal_source_matches_binding", "draft_created", "assets_complete", "registry_matches")


@query("release_publishable", "with bits as (select unnest(range(256)) b), n as (select unnest([0, 1, 2]) p) select b::bigint evidence, p::bigint publications, b = 255 and p = 1 publishable from bits, n")
def release_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishable only with all eight kinds of evidence and exactly one publication, over all cases."""
    cases = spark.range(256 * 3).select(F.expr("id div 3").alias("evidence"), (F.col("id") % 3).alias("publications"))
    for k, name in enumerate(_EVIDENCE):
        cases = cases.withColumn(name, F.col("evidence").bitwiseAND(1 << k) != 0)
    good = F.col("publications") == 1
    for name in _EVIDENCE:
        good = good & F.col(name)
    return cases.select("evidence", "publications", good.alias("publishable"))
