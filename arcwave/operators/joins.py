"""Strongly connected components by joins, in rounds that grow with the logarithm of the depth.

Vertices take scrambled names, so that no order of the input lines up with the order that colours go by.

* Contraction: vertices with one edge in and one out form chains. Pointer doubling between rulers names each chain by its last vertex in rounds that
  grow with log2(length); a chain becomes one edge from the vertex before it to the vertex behind it, which keeps all reachability between the others. Its
  vertices are in the component of both of these, if they have the same one, and alone otherwise. Isolated cycles are found by
  the same doubling. Vertices without edges in or out go as well. As in rake and compress of trees, few such rounds are needed.
* Colours, for what has no chains: each vertex learns the largest name that reaches it. Names flood along edges, and by shortcuts:
  whatever reaches a vertex's colour reaches the vertex, so the colour of the colour is taken too, and distances double. Every
  colour is a pivot of its own in the same round. Inside its class a vertex belongs to the pivot's component if the same flood
  against the edges brings it the pivot's name. Classes share no component, so edges between them go. Names are as good as
  random, so classes shrink as the pieces of a quicksort do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwave.functions import kernels
from arcwave.plans.lineage import Layers, Table
from arcwave.plans.spread import spread_join

#: An odd factor: x -> x * FACTOR mod 2**32 is a bijection of dense ids, and the product fits a bigint.
FACTOR = 1_640_531_527
_BACK = pow(FACTOR, -1, 1 << 32)
#: Chains of up to so many links in all are followed by one task: some hundred MB of arrays.
CORE = 2_000_000
#: One vertex of so many is a ruler of its chain.
RULERS = 8
#: Contraction goes on while a round leaves at most this share of the edges.
WORTH = 0.8
#: A round of contraction is left out where at most this share of the edges' ends is at vertices that it could take away.
SLIGHT = 0.01


def _counted() -> dict[str, Column]:
    return {"n": F.count(F.lit(1))}


def scrambled(c: Column) -> Column:
    return F.pmod(c * F.lit(FACTOR), F.lit(1 << 32))


def unscrambled(c: Column) -> Column:
    high = F.pmod(c * F.lit(_BACK >> 16), F.lit(1 << 16)) * F.lit(1 << 16)
    return F.pmod(high + c * F.lit(_BACK & 0xFFFF), F.lit(1 << 32))


@dataclass
class Rounds:
    """How many rounds of each kind were run; a round is one written table over edges or vertices."""

    contract: int = 0
    double: int = 0
    flood: int = 0
    colour: int = 0
    notes: list[str] = field(default_factory=list)

    @property
    def total(self) -> int:
        return self.contract + self.double + self.flood + self.colour


def _open() -> Column:
    return ~F.col("ended") & ~F.col("at_ruler")


def chained(links: DataFrame, rounds: Rounds, core: int = CORE, level: int = 0) -> DataFrame:
    """From (v, nxt, d, least, tail) with each v once: (v, last, ended, least, d), written, of the chain or tree branch that starts at v.

    ``last`` is the ``tail`` of the last vertex on it that has a link of its own, where ``ended``, and ``d`` the sum of its links; on a cycle nothing ends. ``least`` is the smallest.
    One vertex of ``RULERS`` is a ruler, by hash. Pointers double until they meet one, so most stop after a few rounds; then
    the rulers alone, with links from one to the next, are the same problem. Rows are few times the input's in all, in place of log2(length) times: what
    no open pointer met in a round meets none later, as these only come to the targets of targets, so a round reads what the last one met.
    """
    ruler = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(RULERS)) == 0
    row = lambda *c: ("v", *c, ruler("last").alias("at_ruler"))
    kept = ("v", "last", "ended", "least", "d", "at_ruler")
    watch = {"n": F.count(F.lit(1)), "open": F.count_if(_open())}
    after = links.select(F.col("v").alias("w"))
    first = links.join(after, F.col("nxt") == F.col("w"), "left").select("v", F.coalesce("w", "tail").alias("last"), F.col("w").isNull().alias("ended"), F.least("least", F.coalesce("w", "v")).alias("least"), "d")
    now = Table(first.select(*row("last", "ended", "least", "d")), watch)
    count = now.seen["n"] or 0
    if count <= core:
        rounds.double += 1
        task = lambda t: pa.table(kernels.chains(*(t.column(c).to_numpy() for c in ("v", "last", "ended", "least", "d"))))
        return Table(now.df.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(task, "v bigint, last bigint, ended boolean, least bigint, d bigint")).df
    reach, settled, met = 1, [], None
    while reach < 2 * count and now.seen["open"]:
        rounds.double += 1
        settled.append(now.df.filter(~_open()).select(*kept))
        # what a pointer meets next, one met before: an open row's target, or a settled row that some pointer met in the last round
        ahead = now.df.select(*kept) if met is None else now.df.select(*kept).unionByName(met)
        step = ahead.select(F.col("v").alias("w"), F.col("last").alias("to"), F.col("ended").alias("e"), F.col("least").alias("l"), F.col("d").alias("more"))
        moved = now.df.filter(_open()).select(*kept).join(step, F.col("last") == F.col("w")).select("v", F.col("to").alias("last"), F.col("e").alias("ended"), F.least("least", "l").alias("least"), (F.col("d") + F.col("more")).alias("d"), "w", "l", "more")
        now, reach = Table(moved.select(*row("last", "ended", "least", "d"), "w", "l", "more"), watch), 2 * reach
        met = now.df.filter(~_open()).select(F.col("w").alias("v"), "last", "ended", F.col("l").alias("least"), F.col("more").alias("d"), "at_ruler").dropDuplicates(["v"])
    every = reduce(DataFrame.unionByName, settled, now.df.select(*kept))
    alone = every.filter("ended or not at_ruler").drop("at_ruler")  # what is left open is a cycle without a ruler
    joined = every.filter("not ended and at_ruler")
    stops = every.filter(ruler("v")).filter("ended or at_ruler")
    tops = chained(stops.select("v", F.when(~F.col("ended"), F.col("last")).alias("nxt"), "d", "least", F.col("last").alias("tail")), rounds, core, level + 1)
    tops = tops.select(F.col("v").alias("w"), F.col("last").alias("to"), F.col("ended").alias("e"), F.col("least").alias("l"), F.col("d").alias("more"))
    met = joined.join(tops, F.col("last") == F.col("w")).select("v", F.col("to").alias("last"), F.col("e").alias("ended"), F.least("least", "l").alias("least"), (F.col("d") + F.col("more")).alias("d"))
    return Table(alone.unionByName(met)).df


def doubled(links: DataFrame, rounds: Rounds, core: int | None = None) -> DataFrame:
    """From (v, nxt) with each vertex at most once on either side: (v, last, ended, least), written.

    ``last`` is the last vertex of v's chain that has a link of its own, where ``ended``; on a cycle nothing ends, and ``least`` is its smallest vertex.
    """
    found = chained(links.select("v", "nxt", F.lit(1).cast("bigint").alias("d"), F.col("v").alias("least"), F.col("v").alias("tail")), rounds, CORE if core is None else core)
    return found.select("v", "last", "ended", "least")


def _contracted(held: Table, rounds: Rounds) -> tuple[Table, DataFrame | None, tuple[DataFrame, DataFrame] | None]:
    """(edges left, counted, (v, rep) of isolated cycles, (chains (v, last), their ends (last, h, t))); ``held`` itself, where degrees show that hardly an edge would go."""
    rounds.contract += 1
    edges = held.df
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("v"), one.alias("outs"), none.alias("ins"), F.col("b").alias("nxt")).unionByName(edges.select(F.col("b").alias("v"), none.alias("outs"), one.alias("ins"), F.lit(None).cast("bigint").alias("nxt")))
    table = Table(ends.groupBy("v").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"), F.max("nxt").alias("nxt")), {"links": F.count_if((F.col("outs") == 1) & (F.col("ins") == 1)), "loose": F.sum(F.when((F.col("outs") == 0) | (F.col("ins") == 0) | ((F.col("outs") == 1) & (F.col("ins") == 1)), F.col("outs") + F.col("ins")))})
    if (table.seen["loose"] or 0) <= SLIGHT * (held.seen["n"] or 0):
        table.drop()
        return held, None, None
    degrees = table.df
    links = degrees.filter("outs = 1 and ins = 1").select("v", "nxt")
    keep, cycles, folds = degrees.select("v", "outs", "ins", F.lit(None).cast("bigint").alias("last")), None, None
    if table.seen["links"]:
        chains = doubled(links, rounds)
        cycles = chains.filter("not ended").select("v", F.col("least").alias("rep"))
        keep = degrees.join(chains.select("v", "last"), "v", "left").select("v", "outs", "ins", "last")
    at_a = keep.select(F.col("v").alias("a"), F.col("ins").alias("a_ins"), F.col("last").alias("a_last"))
    at_b = keep.select(F.col("v").alias("b"), F.col("outs").alias("b_outs"), F.col("last").alias("b_last"))
    seen = Table(edges.join(at_a, "a").join(at_b, "b").filter("a_last is null")).df
    plain = seen.filter("b_last is null and a_ins > 0 and b_outs > 0").select("a", "b")
    if cycles is not None:
        heads = seen.filter("b_last is not null").select(F.col("b_last").alias("last"), F.col("a").alias("h"))
        tails = chains.filter("ended and v = last").select("last").join(links.select(F.col("v").alias("last"), F.col("nxt").alias("t")), "last")
        joined = Table(heads.join(tails, "last").select("last", "h", "t")).df
        folds = (chains.filter("ended").select("v", "last"), joined)
        plain = plain.unionByName(joined.filter("h <> t").select(F.col("h").alias("a"), F.col("t").alias("b"))).distinct()
    return Table(plain, _counted()), cycles, folds


def flooded(vertices: DataFrame, edges: DataFrame, rounds: Rounds) -> DataFrame:
    """(v, c), written: the largest vertex that reaches v along (a, b), v itself included."""
    rounds.flood += 1
    own = vertices.select("v", F.col("v").alias("c"))
    # every vertex still has its own name, so the first round needs no join
    now = Table(own.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("c"))).groupBy("v").agg(F.max("c").alias("c")), {"up": F.count_if(F.col("c") > F.col("v"))})
    while now.seen["up"]:
        rounds.flood += 1
        none = F.lit(None).cast("bigint")
        heard = edges.join(now.df.select(F.col("v").alias("a"), "c"), "a").select(F.col("b").alias("v"), "c", none.alias("own"))
        best = now.df.select("v", "c", F.col("c").alias("own")).unionByName(heard).groupBy("v").agg(F.max("c").alias("c"), F.max("own").alias("own"))
        # a shortcut for each colour whose own colour is larger: few in the end, where most vertices share a colour
        tops = now.df.select("c").distinct().join(now.df.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c").filter("cc > c")
        new = Table(best.join(tops, "c", "left").select("v", F.coalesce("cc", "c").alias("c"), "own"), {"up": F.count_if(F.col("c") > F.col("own"))})
        now.drop()
        now = new
    return now.df.select("v", "c")


def _coloured(edges: DataFrame, rounds: Rounds) -> tuple[Table, DataFrame]:
    """(edges left, counted, (v, rep) of every colour's component)."""
    rounds.colour += 1
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    colour = flooded(ends, edges, rounds)
    tinted = edges.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    inside = Table(tinted.filter("ca = cb").select("a", "b")).df
    back = flooded(colour, inside.select(F.col("b").alias("a"), F.col("a").alias("b")), rounds)
    table = Table(colour.join(back.withColumnRenamed("c", "d"), "v").select("v", F.col("c").alias("rep"), (F.col("c") == F.col("d")).alias("same")), {"rest": F.count_if(~F.col("same"))})
    if not table.seen["rest"]:
        return Table(inside.limit(0), _counted()), table.df.select("v", "rep")
    both = table.df
    rest = both.filter("not same").select("v")
    left = inside.join(rest.select(F.col("v").alias("a")), "a", "left_semi").join(rest.select(F.col("v").alias("b")), "b", "left_semi")
    return Table(left, _counted()), both.filter("same").select("v", "rep")


def components_by_joins(edges: DataFrame, rounds: Rounds | None = None, core_edges: int = 0, core: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(dense, least) for every vertex whose component has two or more; ``edges`` has distinct (src, dst) of dense ids.

    Once at most ``core_edges`` edges are left, ``core`` takes them, (a, b), in one task and gives (v, rep); by default nothing is left to it.
    """
    rounds = rounds if rounds is not None else Rounds()
    table = Table(edges.filter("src <> dst").select(scrambled(F.col("src")).alias("a"), scrambled(F.col("dst")).alias("b")), _counted())
    found, folds = Layers(), []
    count = table.seen["n"] or 0
    while count:
        if core is not None and count <= core_edges:
            found.add(core(table.df))
            rounds.notes.append(f"{count} edges in one task")
            break
        before = count
        table, cycles, fold = _contracted(table, rounds)
        if cycles is not None:
            found.add(cycles)
            folds.append(fold)
        count = table.seen["n"] or 0
        rounds.notes.append(f"contracted {before} edges to {count}")
        if count > WORTH * before:
            table, group = _coloured(table.df, rounds)
            found.add(group)
            rounds.notes.append(f"coloured {count} edges, {(count := table.seen['n'] or 0)} left")
    if not found.held:
        return edges.limit(0).select(F.col("src").alias("dense"), F.col("dst").alias("least"))
    for chains, ends in reversed(folds):
        known = lambda c, name: found.df.select(F.col("v").alias(c), F.col("rep").alias(name))  # noqa: E731, B023
        same = ends.join(known("h", "ch"), "h", "left").join(known("t", "ct"), "t", "left").filter("h = t or ch = ct")
        same = Table(same.select("last", "t", F.coalesce("ct", "t").alias("rep"), F.col("ct").isNull().alias("fresh"))).df
        found.add(chains.join(same, "last").select("v", "rep").unionByName(same.filter("fresh").select(F.col("t").alias("v"), "rep").distinct()))
    named = found.df.select(unscrambled(F.col("v")).alias("dense"), "rep")
    sizes = Table(named.groupBy("rep").agg(F.min("dense").alias("least"), F.count(F.lit(1)).alias("n"))).df
    return spread_join(named, sizes.select("rep", "least"), ["rep"], "dense", counts=sizes.select("rep", "n")).select("dense", "least")
