"""Dense global positions without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwave.plans.lineage import cut

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row number below


def global_rank(df: DataFrame, keys: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` = 0-based position in ascending order of ``keys``.

    Rows are range-partitioned and sorted, and numbered inside their partition; only one row for each
    partition (its size) is ordered globally. Make ``keys`` a total order for a repeatable answer:
    a key held by very many rows is then split among partitions too. The numbered rows are written,
    so the partition bounds are sampled once.
    """
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    local = cut(ranged.sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    return _numbered(local, name)


def _numbered(local: DataFrame, name: str) -> DataFrame:
    part, row = F.shiftright("__id", _LOCAL_BITS), F.col("__id").bitwiseAND((1 << _LOCAL_BITS) - 1)
    sizes = local.groupBy(part.alias("__part")).agg((F.max(row) + 1).alias("__size"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    # one row per partition of the job: bounded by the number of shuffle partitions
    return local.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + row).drop("__part", "__before", "__id")


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` with the 0-based position of each row in the order that Spark reads it; the numbered rows are written."""
    local = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    return _numbered(local, name)
