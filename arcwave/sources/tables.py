"""Graphs that the relational test tables hold: who follows whom inside an order, a day, a dialogue or a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcwave.graph import Graph
from arcwave.operators.ranking import global_rank

Inputs = tuple[DataFrame, DataFrame]

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pairs(df: DataFrame, key: Column, order: object, keep: str | None = None) -> DataFrame:
    found = df.withColumn("s", key).withColumn("t", F.lead(key).over(order))
    return (found.filter(keep) if keep else found).filter("t is not null").select("s", "t")


def copart(spark: SparkSession, sf_dir: str) -> Inputs:
    """Parts; from a part bought in bulk to the next part of its order."""
    lines = _read(spark, sf_dir, "lineitem")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), _pairs(lines, F.col("l_partkey"), Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER), "l_quantity >= 48")


def cosupp(spark: SparkSession, sf_dir: str) -> Inputs:
    """Suppliers; from a supplier of a large discounted line to that of the next line."""
    lines = _read(spark, sf_dir, "lineitem")
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), _pairs(lines, F.col("l_suppkey"), Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER), "l_quantity >= 50 and l_discount >= 0.09")


def handoff(spark: SparkSession, sf_dir: str) -> Inputs:
    """Customers; from an urgent finished order's customer to that of the next order in time."""
    pairs = _handed(_read(spark, sf_dir, "orders"), "o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), pairs


def _handed(orders: DataFrame, keep: str = "true") -> DataFrame:
    """(s, t) of consecutive orders. The order is global, so rows are ranked first."""
    columns = orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")
    placed = global_rank(columns, [F.col("o_orderdate"), F.col("o_orderkey")], "r")
    after = placed.select((F.col("r") - 1).alias("r"), F.col("o_custkey").alias("t"))
    return placed.filter(keep).join(after, "r").select(F.col("o_custkey").alias("s"), "t")


def copart_whole(spark: SparkSession, sf_dir: str) -> Inputs:
    """Parts; from each part to the next part of its order, over every line."""
    pairs = _pairs(_read(spark, sf_dir, "lineitem"), F.col("l_partkey"), Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), pairs


def cosupp_whole(spark: SparkSession, sf_dir: str) -> Inputs:
    """Suppliers; from each line's supplier to that of the next line of its order, over every line."""
    pairs = _pairs(_read(spark, sf_dir, "lineitem"), F.col("l_suppkey"), Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), pairs


def handoff_whole(spark: SparkSession, sf_dir: str) -> Inputs:
    """Customers; from each order's customer to that of the next order in time, over every order."""
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _handed(_read(spark, sf_dir, "orders"))


def ledger(spark: SparkSession, sf_dir: str) -> Inputs:
    """Orders, each to the next one in time, over every order: one path as long as the table."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    placed = global_rank(orders, [F.col("o_orderdate"), F.col("o_orderkey")], "r")
    after = placed.select((F.col("r") - 1).alias("r"), F.col("o_orderkey").alias("t"))
    return orders.select(F.col("o_orderkey").alias("k")), placed.join(after, "r").select(F.col("o_orderkey").alias("s"), "t")


def dialogue(spark: SparkSession, sf_dir: str) -> Inputs:
    """Turns of conversations, each to the next; a key is both numbers, with zeros in front so that it sorts as they do."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("%019d:%019d", "conv_id", "turn").alias("k"))
    return turns.select("k"), _pairs(turns, F.col("k"), Window.partitionBy("conv_id").orderBy("turn"))


def journeys(spark: SparkSession, sf_dir: str) -> Inputs:
    """Kinds of events of each user (keys "user:kind"), each to the kind of the user's next event, over every event: as many parts as users."""
    events = _read(spark, sf_dir, "events")
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return events.select(key.alias("k")), _pairs(events, key, Window.partitionBy("user_id").orderBy("ts", "event_id"))


def event_types(spark: SparkSession, sf_dir: str) -> Inputs:
    """Kinds of events (string keys), each to the kind of its user's next event."""
    events = _read(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("k")), _pairs(events, F.col("event_type"), Window.partitionBy("user_id").orderBy("ts", "event_id"))


def graph(inputs: Inputs) -> Graph:
    return Graph.from_edges(*inputs)


def chain(spark: SparkSession, n: int) -> Graph:
    return Graph.from_dense_edges(spark, n, spark.range(max(n - 1, 0)).select("id", (F.col("id") + 1).alias("next")))


def star(spark: SparkSession, n: int) -> Graph:
    return Graph.from_dense_edges(spark, n, spark.range(1, n).select(F.lit(0).cast("bigint").alias("hub"), "id"))


def complete(spark: SparkSession, n: int) -> Graph:
    ids = spark.range(n)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    pairs = ids.select("id", F.explode(every).alias("to")).filter("id <> to")
    return Graph.from_dense_edges(spark, n, pairs)
