"""Last write wins over a stream: state is bounded by subjects, not by time, so there is no watermark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.merge import State, latest
from tidemark.operators.verify import Rejected

# Seconds until a subscription is tried again, where its source isn't there and after another error.
NOT_FOUND_S, ERROR_S = 4, 5


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_snapshots(stream: DataFrame, folder: str, checkpoint: str, key: str = "subject_id") -> StreamingQuery:
    """Folds each batch's winners into the snapshot before and writes folder/batch as Parquet.

    Late rows with a lower (version, is_tomb, sig) change nothing. A batch that is run again
    reads the same snapshot and overwrites its own.
    """

    def fold(batch: DataFrame, n: int) -> None:
        rows = latest(batch, key)
        if n:
            rows = latest(batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/{n - 1}").unionByName(rows), key)
        rows.write.mode("overwrite").parquet(f"{folder}/{n}")

    return _start(stream, fold, checkpoint)


def last_snapshot(query: StreamingQuery, spark: SparkSession, folder: str, schema) -> DataFrame:
    """The winners after the last batch that the query ran."""
    ran = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return spark.read.schema(schema).parquet(f"{folder}/{max(ran)}") if ran else spark.createDataFrame([], schema)


class Latest(StatefulProcessor):
    """Keeps a subject's whole winning row, and hands on a row only if it wins over the one kept."""

    def __init__(self, schema: StructType, key: str) -> None:
        self.schema, self.key = schema, key
        self.names = [f.name for f in schema.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType([f for f in self.schema.fields if f.name != self.key]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  names of the interface
        import pandas as pd

        others = [n for n in self.names if n != self.key]
        rank = [others.index(c) for c in ("version", "is_tomb", "sig")]
        best = tuple(self.kept.get()) if self.kept.exists() else None
        before = best
        for part in rows:
            for row in part[others].itertuples(index=False, name=None):
                row = tuple(x.item() if hasattr(x, "item") else x for x in row)
                if best is None or tuple(row[i] for i in rank) > tuple(best[i] for i in rank):
                    best = row
        if best is not None and best is not before:
            self.kept.update(best)
            yield pd.DataFrame([{self.key: key[0], **dict(zip(others, best, strict=True))}], columns=self.names)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: str = "subject_id") -> DataFrame:
    """A stream of what changes: the rows of (key, version, is_tomb, sig, ...) that win over all of their subject before them.

    The winners lie in the state store by subject, so a batch costs what it brings, not what there is. Late rows
    with a lower (version, is_tomb, sig) change nothing, at whatever time they come. The session
    must use the RocksDB state store.
    """
    return stream.groupBy(key).transformWithStateInPandas(Latest(stream.schema, key), outputStructType=stream.schema, outputMode="Update", timeMode="None")


def into_changes(stream: DataFrame, folder: str, checkpoint: str, key: str = "subject_id") -> StreamingQuery:
    """Appends each batch's changes as folder/batch=n; a batch that is run again overwrites its own."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return changes(stream, key).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def winners(spark: SparkSession, folder: str, schema: StructType, key: str = "subject_id") -> DataFrame:
    """What the changes so far amount to."""
    return latest(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder), key)


def not_found(error: BaseException) -> bool:
    """Whether a subscription failed because its source isn't there (yet)."""
    return any(sign in str(error) for sign in ("PATH_NOT_FOUND", "FileNotFoundException", "does not exist"))


def supervised(start: Callable[[], StreamingQuery], tries: int | None = None, wait: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Runs a query until it ends by itself, starting it again after each failure, from its checkpoint.

    It waits NOT_FOUND_S where the source isn't there and ERROR_S otherwise. After `tries` failures the last one is raised; None goes on.
    """
    failures = 0
    while True:
        try:
            run = start()
            run.awaitTermination()
            return run
        except Exception as e:  # what a query fails with is of many kinds
            failures += 1
            if tries is not None and failures >= tries:
                raise
            wait(NOT_FOUND_S if not_found(e) else ERROR_S)


def into_states(stream: DataFrame, read: Callable[[], State], write: Callable[[State], None], apply: Callable[[State, State], State], checkpoint: str, refused: str | None = None) -> StreamingQuery:
    """The delta sink: each batch's winners are an untrusted delta that apply judges over the state that is read, and the result is written.

    A delta that apply refuses is set aside as refused/batch=n with its reason, and the next is taken; without
    that folder it raises and stops the query with nothing written.
    """

    def send(batch: DataFrame, n: int) -> None:
        state = read()
        delta = State(latest(batch), state.key_auth.limit(0), state.registry.limit(0))
        if delta.records.isEmpty():
            return
        try:
            write(apply(state, delta))
        except Rejected as e:
            if refused is None:
                raise
            batch.withColumn("reason", F.lit(str(e))).write.mode("overwrite").parquet(f"{refused}/batch={n}")

    return _start(stream, send, checkpoint)
