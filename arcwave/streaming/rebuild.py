"""A graph kept up with a stream of edges: an extension of ours, as the batch operators have no stream of their own.

Each micro-batch is appended to a table of distinct edges under its batch id, so a batch that is run again after a
failure replaces its own rows; the handler then gets the canonical graph of all edges so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arcwave.graph import BuildOptions, Graph


def maintain(edges: DataFrame, store: str, checkpoint: str, handle: Callable[[Graph, int], None], options: BuildOptions | None = None, once: bool = False) -> StreamingQuery:
    """Starts the query over a stream whose first two columns are the ends of edges; vertices are all ends seen so far."""
    src, dst = edges.columns[:2]

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(F.col(src).alias("s"), F.col(dst).alias("t")).filter("s is not null and t is not null").distinct().write.mode("overwrite").parquet(f"{store}/batch={number}")
        known = spark.read.option("basePath", store).parquet(f"{store}/batch=*").select("s", "t").distinct()
        nodes = known.select(F.explode(F.array("s", "t")).alias("k"))
        handle(Graph.from_edges(nodes, known, options), number)

    writer = edges.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
