"""Positions of rows in a total order, without bringing them into one task, and the folder that this needs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the session names in spark.checkpoint.dir; where that is unset, a temporary
    folder is used on a local master, and a cluster is refused.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of a table that a shuffle partition stands for.
PART_ROWS = 500_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """What is computed inside has these settings of the session."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def parts_for(spark: SparkSession, rows: int, each: int = PART_ROWS) -> Iterator[None]:
    """What is computed inside has at least a shuffle partition for so many rows, so that a task's share doesn't grow with the table."""
    name = "spark.sql.shuffle.partitions"
    with settings(spark, {name: str(max(int(spark.conf.get(name)), 1 + rows // each))}):
        yield


def remove(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Deletes a folder that is no longer read, now or as the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where) if at_exit else files.delete(where, True)


def with_places(rows: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """Adds `out`: 1, 2, 3 ... in a total order of all rows.

    Rows are dealt by range and sorted there, once; each task numbers its own rows, and what comes
    to the driver is one count for each task.
    """
    at, pid, before = "_at", "_pid", "_before"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    shared_folder(rows.sparkSession)
    dealt = dealt.checkpoint(eager=True).withColumn(pid, F.shiftright(at, 33))
    counts, sofar = [], 0
    for r in sorted(dealt.groupBy(pid).agg(F.min(at).alias("first"), F.count("*").alias("n")).collect(), key=lambda r: r[pid]):
        counts.append((r[pid], 1 + sofar - r["first"]))
        sofar += r["n"]
    table = rows.sparkSession.createDataFrame(counts, f"{pid} long, {before} long")
    return dealt.join(F.broadcast(table), pid).withColumn(out, (F.col(at) + F.col(before)).cast("long")).drop(at, pid, before)


def durable(rows: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so lost executors cost no more than their own work."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
