"""Lineage cuts that survive lost executors: tables in the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTING = "spark.checkpoint.dir"
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
#: Largest side that Spark may choose to broadcast while a table is written. Such a side goes through the driver, and rounds have many joins: at Spark's own
#: 10 MB each, what the driver takes grows with the graph. Sides that a hint marks are bounded by their callers.
BROADCAST_BYTES = 64 << 10


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, as in tests, a local session gets a temporary one; a cluster must name its own."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return shared_dir(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever its file system is."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def few_broadcasts(spark: SparkSession, most: int = BROADCAST_BYTES) -> Iterator[None]:
    """Lowers the size up to which Spark broadcasts a side of its own accord to ``most`` bytes; a lower setting of the session stays."""
    before = spark.conf.get(THRESHOLD)
    lower = not before.lstrip("-").isdigit() or int(before) > most  # a size with a unit is above any that we would keep
    if lower:
        spark.conf.set(THRESHOLD, str(most))
    try:
        yield
    finally:
        if lower:
            spark.conf.set(THRESHOLD, before)


_open: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


class Scope:
    """Deletes, when the block ends or fails, all tables that were written in it but those kept; these belong to the scope around it, if any."""

    def __init__(self) -> None:
        self.tables: list[Table] = []

    def __enter__(self) -> Scope:
        self._token = _open.set((*_open.get(), self))
        return self

    def __exit__(self, *_: object) -> None:
        _open.reset(self._token)
        for t in self.tables:
            t.drop()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that outlives the block: its own, where it is one's ``df``, else a new one."""
        table = next((t for t in self.tables if t.df is df), None) or Table(df)
        if table in self.tables:
            self.tables.remove(table)
        around = _open.get()[:-1]
        if around:
            around[-1].tables.append(table)
        return table.df


class Table:
    """A DataFrame written as Parquet in the shared folder; ``df`` reads it, ``drop`` deletes it.

    ``watch`` names aggregates that are taken while the rows are written, so that they cost no job of their own; they are in ``seen``.
    ``folders`` are columns whose values get a folder each, so that a filter on them lists no other files.
    """

    def __init__(self, df: DataFrame, watch: dict[str, Column] | None = None, folders: Sequence[str] = (), **options: object) -> None:
        self.spark = df.sparkSession
        eye = Observation()
        if watch:
            df = df.observe(eye, *[c.alias(name) for name, c in watch.items()])
        self.path = f"{shared_dir(self.spark).rstrip('/')}/table-{uuid.uuid4().hex}"
        if _open.get():
            _open.get()[-1].tables.append(self)  # first, so that a failed write goes too
        with few_broadcasts(self.spark):
            df.write.options(**options).partitionBy(*folders).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.seen = {name: eye.get.get(name) for name in watch} if watch else {}

    def drop(self) -> None:
        remove(self.spark, self.path)


class Layers:
    """Rows that come in steps, as written tables; two of one level are merged, so each row is written log2(steps) times at most."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Table]] = []

    def add(self, df: DataFrame, watch: dict[str, Column] | None = None) -> Table:
        """Writes ``df``, which may read the layers, as the newest one, and merges older ones; the returned table stays until the next call."""
        newest = Table(df, watch)
        while len(self.held) > 1 and self.held[-1][0] == self.held[-2][0]:
            (_, new), (level, old) = self.held.pop(), self.held.pop()
            self.held.append((level + 1, Table(old.df.unionByName(new.df))))
            old.drop()
            new.drop()
        self.held.append((0, newest))
        return newest

    @property
    def frames(self) -> list[DataFrame]:
        return [t.df for _, t in self.held]

    @property
    def df(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.frames)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: later plans start from the file, and a lost executor costs a reread only."""
    return Table(df).df


#: Rows of a page of a sorted table: what a lookup reads at least.
PAGE_ROWS = 2_048


def sorted_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` as a written table sorted by ``keys``: files are ranges of keys, and a filter on the first key reads the pages that may hold it."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return Table(ranged, **{"parquet.page.row.count.limit": PAGE_ROWS, "parquet.block.size": 32 << 20}).df
