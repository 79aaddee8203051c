"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType

from tidemark.operators.places import remove, shared_folder

__all__ = ["durable", "gapless", "identity", "one_of_each", "partitions", "quoted", "remove", "row_key", "shared_folder", "small_batches", "whole"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Lets Arrow batches to Python workers hold about `most` bytes; a longer text is a batch of its own.

    It is a setting of the session, read as a query is planned to run. Batches by row count alone
    would hold tens of MB of long texts, several times over on their way to a worker and back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        spark.conf.set(name, str(most))


def whole(text: str | Column) -> Column:
    """A text column as it is read by every operator here: null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """One non-null string for (id, text), null text as empty: rows that share it are repeats of one row."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("#"), F.sha2(whole(text_col), 256))


def quoted(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def _told_apart(c: Column, kind: DataType) -> Column:
    """A value as text that no other value of its type shares: JSON for nested ones, in which nulls and texts differ, maps as their entries."""

    def plain(x: Column, t: DataType) -> Column:
        if isinstance(t, MapType):
            return F.transform(F.map_entries(x), lambda e: F.struct(plain(e["key"], t.keyType).alias("k"), plain(e["value"], t.valueType).alias("v")))
        if isinstance(t, ArrayType):
            return F.transform(x, lambda e: plain(e, t.elementType))
        if isinstance(t, StructType):
            return F.when(x.isNotNull(), F.struct(*(plain(x.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(t.fields))))
        return F.hex(x) if isinstance(t, BinaryType) else x.cast("string")

    if isinstance(kind, (MapType, ArrayType, StructType)):
        return F.to_json(F.struct(plain(c, kind).alias("v")), {"ignoreNullFields": "false"})
    return c.cast("string")


def identity(df: DataFrame) -> Column:
    """A hash of a whole row: rows that share it are equal in every column, nulls included, within nested values too."""
    each = [F.coalesce(F.sha2(_told_apart(quoted(f.name), f.dataType).cast("binary"), 256), F.lit("null")) for f in df.schema.fields]
    return F.sha2(F.concat_ws("#", *each), 256)


def one_of_each(df: DataFrame, key: Column) -> DataFrame:
    """(_key, _doc): one whole row of df for each key, the one whose identity is least.

    The caller's columns lie in the struct _doc, so no name of theirs can clash with one of ours.
    """
    rows = df.select(F.struct("*").alias("_doc"), key.alias("_key"), identity(df).alias("_whole"))
    return rows.groupBy("_key").agg(F.min_by("_doc", "_whole").alias("_doc"))


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: 0, 1, 2 ... within each value of keys, in the given order.

    The rows are dealt by range of (keys, order), so a hot key is cut across tasks; each
    task numbers its own rows, and only a row for each (key, task) goes into the prefix sums.
    """
    at, first, n, before, pid = "_at", "_first", "_n", "_before", "_pid"
    dealt = df.repartitionByRange(partitions(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = durable(dealt.withColumn(at, F.monotonically_increasing_id())).withColumn(pid, F.shiftright(at, 33))
    parts = dealt.groupBy(*keys, pid).agg(F.min(at).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    return dealt.join(parts, [*keys, pid]).withColumn(out, (F.col(at) - F.col(first) + F.col(before)).cast("long")).drop(at, first, before, pid)
