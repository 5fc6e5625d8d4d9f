"""Longest-path ranks without a job a rank, and orders of levels without a job a level.

Ranks are a policy iteration over (max, plus). Each vertex picks one predecessor, so the picks are a forest, and the depths in a forest
come by pointer doubling in log2(depth) rounds. Depths are lengths of real paths; where an edge offers more, its target picks that
predecessor, and depths are found again, until no edge offers more. Then depths satisfy the ranks' own equation, which has one solution on an
acyclic graph. A vertex with one predecessor has nothing to pick, so chains take one evaluation, and the number of
evaluations follows the places where paths compete, not the depth.

A forest, where each vertex has one predecessor at most, needs no picks: one evaluation gives ranks, roots and that there is no cycle.

Orders sort a level by (position of the vertex that comes first, or last, among the predecessors on the level before; id). So a vertex is named by a
sequence of ids, and sequences compare as binary strings. ``HOPS`` levels are found in one plan that carries the strings along, and one
global sort turns them into positions; the next plan starts from positions. Orders of very many levels are found by
doubling instead: under a pick for each vertex, sequences of 2, 4, 8... ids are named by their sorted rank in log2(levels) sorts, and picks that
are not the best under these names are taken again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwave.errors import CondensationCycle
from arcwave.operators.joins import CORE, Rounds, chained
from arcwave.operators.ranking import global_rank
from arcwave.plans.lineage import Layers, Table, cut

HOPS = 6
#: Over so many levels an order is found by doubling.
DEEP = 256


def depths(picks: DataFrame, rounds: Rounds, core: int = CORE) -> DataFrame:
    """(v, d), written: how many picks (v, up) lie above each v; vertices without a pick are not in it."""
    found = chained(picks.select("v", F.col("up").alias("nxt"), F.lit(1).cast("bigint").alias("d"), F.col("v").alias("least"), F.col("v").alias("tail")), rounds, core)
    if not found.filter("not ended").isEmpty():
        raise CondensationCycle()
    return found.select("v", "d")


def rooted(edges: DataFrame, edge_count: int, rounds: Rounds, core: int = CORE) -> DataFrame | None:
    """(v, last, ended, least, d), written, for every vertex with a predecessor where the distinct (src, dst) are a forest: ``last`` is its root and ``d`` its depth.

    None where a vertex has two predecessors or the edges hold a cycle.
    """
    most = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if edge_count and most > 1:
        return None
    found = chained(edges.select(F.col("dst").alias("v"), F.col("src").alias("nxt"), F.lit(1).cast("bigint").alias("d"), F.col("dst").alias("least"), F.col("src").alias("tail")), rounds, core)
    return found if found.filter("not ended").isEmpty() else None


def longest_ranks(edges: DataFrame, size: int, rounds: Rounds | None = None) -> DataFrame:
    """(v, rank), written, for every vertex with a predecessor in (src, dst); the others have rank 0. An error on a cycle."""
    rounds = rounds if rounds is not None else Rounds()
    picks = Table(edges.groupBy(F.col("dst").alias("v")).agg(F.max("src").alias("up")))
    while True:
        now = depths(picks.df, rounds)
        rounds.contract += 1
        offers = edges.join(now.select(F.col("v").alias("src"), "d"), "src", "left").groupBy(F.col("dst").alias("v")).agg(F.max(F.struct((F.coalesce("d", F.lit(0)) + 1).alias("d"), "src")).alias("best"))
        better = Table(offers.join(now, "v").filter(F.col("best.d") > F.col("d")).select("v", F.col("best.src").alias("better"), F.col("best.d").alias("d")), {"n": F.count(F.lit(1)), "top": F.max("d")})
        if not better.seen["n"]:
            return now.select("v", F.col("d").alias("rank"))
        if better.seen["top"] >= size:
            raise CondensationCycle()
        new = Table(picks.df.join(better.df.select("v", "better"), "v", "left").select("v", F.coalesce("better", "up").alias("up")))
        picks.drop()
        better.drop()
        picks = new


def _word(c: Column) -> Column:
    """A dense id or position as four bytes that sort as it does."""
    return F.unhex(F.lpad(F.hex(c), 8, "0"))


def walked(edges: DataFrame, start: DataFrame, pick: Callable[[Column], Column], seen_before: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], None], hops: int = HOPS) -> tuple[DataFrame, int, int]:
    """((pos, dense, level), levels, plans): level after level from ``start`` (pos, dense) along (src, dst).

    ``pick`` is the aggregate that chooses among the sequences that reach a vertex (``F.min`` or ``F.max``); ``seen_before`` adds to rows with a column
    ``dst`` whether an earlier plan reached it, as ``__seen``; ``after`` is told the rows of each plan.
    """
    done = Layers()
    ends = edges.select(F.col("src").alias("__src"), "dst")
    watch = {"n": F.count(F.lit(1)), "top": F.max("level")}
    table = done.add(start.select("pos", "dense", F.lit(0).cast("bigint").alias("level")), watch)
    now = table.df
    after(now)
    placed, level, plans = table.seen["n"] or 0, 0, 0
    while placed:
        plans += 1
        sign, least = (1, F.min) if pick is F.min else (-1, F.max)
        found = now.filter(F.col("level") == level).select("dense", F.lit(0).alias("hop"), _word(F.col("pos")).alias("key"))
        for hop in range(hops):
            # each row stays, and the newest ones bring their targets; what comes twice counts on its first level
            met = seen_before(found.join(ends, (F.col("dense") == F.col("__src")) & (F.col("hop") == hop), "left"))
            fresh = F.struct(F.col("dst").alias("dense"), (F.col("hop") + 1).alias("hop"), F.concat("key", _word(F.col("dst"))).alias("key"))
            both = F.array(F.struct("dense", "hop", "key"), F.when(F.col("dst").isNotNull() & ~F.col("__seen"), fresh))
            best = met.select(F.explode(both).alias("x")).filter("x is not null").groupBy(F.col("x.dense").alias("dense")).agg(least(F.struct((sign * F.col("x.hop")).alias("hop"), F.col("x.key").alias("key"))).alias("best"))
            found = best.select("dense", (sign * F.col("best.hop")).alias("hop"), F.col("best.key").alias("key"))
        rows = Table(found.filter("hop > 0"))  # a range sort samples its input, which would run the hops twice
        ranked = global_rank(rows.df, [F.col("hop"), F.col("key")], "k")
        table = done.add(ranked.select((F.col("k") + placed).alias("pos"), "dense", (F.col("hop") + level).cast("bigint").alias("level")), watch)
        now, seen = table.df, table.seen
        if not seen["n"]:
            break
        after(now)
        placed += seen["n"]
        if seen["top"] < level + hops:
            return done.df, seen["top"] + 1, plans
        level = seen["top"]
    return done.df, level + 1 if placed else 0, plans


def named(picked: DataFrame, waves: int, rounds: Rounds | None = None) -> DataFrame:
    """(v, rank, pos) from (v, rank, up): the order by rank, then by the picks' sequence of ids, by doubling.

    Where a rank has one vertex alone, all later ones come from it, so sequences end behind the last such rank.
    """
    single = picked.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select((F.col("rank") + 1).alias("rank"), F.lit(True).alias("forced"))
    picked = picked.join(single, "rank", "left").select("v", "rank", F.when(F.col("forced").isNull(), F.col("up")).alias("up"))
    watch = {"open": F.count("up")}
    now = Table(picked.select("v", "rank", "up", F.col("v").alias("name")), watch)
    reach = 1
    while reach < waves and now.seen["open"]:
        if rounds is not None:
            rounds.double += 1
        above = now.df.select(F.col("v").alias("up"), F.col("name").alias("upper"), F.col("up").alias("next"))
        pairs = cut(now.df.join(above, "up", "left").select("v", "rank", F.col("next").alias("up"), F.coalesce("upper", F.lit(-1)).alias("upper"), "name"))
        ranked = global_rank(pairs.select("upper", "name").distinct(), [F.col("upper"), F.col("name")], "new")
        new = Table(pairs.join(ranked, ["upper", "name"]).select("v", "rank", "up", F.col("new").alias("name")), watch)
        now.drop()
        now, reach = new, reach * 2
    return global_rank(now.df, [F.col("rank"), F.col("name"), F.col("v")], "pos").select("v", "rank", "pos")


def queue_order(edges: DataFrame, ranks: DataFrame, waves: int, rounds: Rounds | None = None, deep: int = DEEP) -> DataFrame:
    """(v, rank, pos) of the first-in-first-out order; ``ranks`` has (v, rank) of every vertex, ``edges`` the distinct (src, dst)."""
    rounds = rounds if rounds is not None else Rounds()
    low, high = (ranks.select(F.col("v").alias(c), F.col("rank").alias(r)) for c, r in (("src", "low"), ("dst", "high")))
    tight = cut(edges.join(low, "src").join(high, "dst").filter("high = low + 1").select("src", "dst"))
    if waves <= deep:
        start = global_rank(ranks.filter("rank = 0"), [F.col("v")], "pos").select("pos", F.col("v").alias("dense"))
        order, _, plans = walked(tight, start, F.max, lambda df: df.withColumn("__seen", F.lit(False)), lambda df: None)
        rounds.contract += plans
        return order.select(F.col("dense").alias("v"), F.col("level").alias("rank"), "pos")
    picks = cut(tight.groupBy(F.col("dst").alias("v")).agg(F.max("src").alias("up")))
    contested = cut(tight.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dst"))
    forced = contested.isEmpty()
    rivals = cut(tight.join(contested, "dst", "left_semi"))
    while True:
        order = cut(named(ranks.join(picks, "v", "left").select("v", "rank", "up"), waves, rounds))
        if forced:
            return order
        rounds.contract += 1
        best = rivals.join(order.select(F.col("v").alias("src"), "pos"), "src").groupBy(F.col("dst").alias("v")).agg(F.max(F.struct("pos", "src")).alias("best")).select("v", F.col("best.src").alias("better"))
        new = picks.join(best, "v", "left").select("v", F.coalesce("better", "up").alias("up"), (F.coalesce("better", "up") != F.col("up")).alias("moved"))
        table = Table(new, {"moved": F.count_if("moved")})
        if not table.seen["moved"]:
            return order
        picks = table.df.select("v", "up")
