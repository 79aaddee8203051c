"""The message replica: fitness gate, incremental scan, and a Python data source over SQLite."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidemark.functions.columns import reconcile_epoch
from tidemark.schema import MAX_RECONCILE_AGE


def gate_reason(schema_version: Column, room_known: Column, generation_ok: Column, last_ok: Column, now: int) -> Column:
    """Why a replica can't be trusted, or null; what can't be told counts against it."""
    age = F.lit(now) - reconcile_epoch(last_ok)
    return (
        F.when(~F.coalesce(schema_version == 1, F.lit(False)), "schema version")
        .when(~F.coalesce(room_known, F.lit(False)), "no state for the room")
        .when(~F.coalesce(generation_ok == 1, F.lit(False)), "generation not attested")
        .when(age.isNull(), "never reconciled")
        .when(age < 0, "reconciled in the future")
        .when(age > MAX_RECONCILE_AGE, "stale")
    )


def messages_since(messages: DataFrame, room, cursor: int, limit: int) -> DataFrame:
    """The oldest messages of a room after the cursor; deleted ones don't show."""
    return messages.where((F.col("room") == room) & (F.col("seq") > cursor) & ~F.col("deleted")).orderBy("seq").limit(limit).select("seq", "author_id", "content")


def epoch(text: str) -> int | None:
    """reconcile_epoch of one string."""
    fields = [text.strip()[a:b] for a, b in ((0, 4), (5, 7), (8, 10), (11, 13), (14, 16), (17, 19))]
    if not all(re.fullmatch("[+-]?[0-9]+", f) for f in fields) or len(text.strip().encode()) < 19:
        return None
    year, month, day, hour, minute, second = map(int, fields)
    if not 1 <= month <= 12 or not 1 <= day <= 31 or year < 1:
        return None
    return (date(year, month, 1).toordinal() - date(1970, 1, 1).toordinal() + day - 1) * 86_400 + hour * 3600 + minute * 60 + second


def check_replica(path: str, room: str, now: int) -> str | None:
    """gate_reason of a SQLite file; a missing file raises."""
    with sqlite3.connect(f"file:{Path(path).resolve()}?mode=ro", uri=True) as db:
        version = db.execute("SELECT CAST(value AS INTEGER) FROM meta WHERE key = 'schema_version'").fetchone()
        if version is None:
            raise ValueError("no schema_version")
        if version[0] != 1:
            return "schema version"
        row = db.execute("SELECT generation_ok, COALESCE(last_reconcile_ok_at, '') FROM mirror_state WHERE room = ?", [room]).fetchone()
    if row is None:
        return "no state for the room"
    if row[0] != 1:
        return "generation not attested"
    at = epoch(row[1])
    if at is None:
        return "never reconciled"
    return "reconciled in the future" if at > now else "stale" if now - at > MAX_RECONCILE_AGE else None


SCHEMA = "seq bigint, author_id string, content string"


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class ReplicaReader(DataSourceReader):
    """Reads ranges of seq; room and cursor go into the query, so only matching rows leave the file."""

    def __init__(self, options: dict) -> None:
        self.path, self.room, self.cursor, self.parts = options["path"], options["room"], int(options.get("cursor", -1)), int(options.get("partitions", 1))
        reason = check_replica(self.path, self.room, int(options["now"])) if "now" in options else None
        if reason:
            raise ValueError(reason)

    def _db(self):
        return sqlite3.connect(f"file:{Path(self.path).resolve()}?mode=ro", uri=True)

    def partitions(self):
        with self._db() as db:
            last = db.execute("SELECT COALESCE(MAX(seq), -1) FROM messages WHERE room = ?", [self.room]).fetchone()[0]
        step = max(1, -(-(last - self.cursor) // self.parts))
        return [Range(a, min(last, a + step)) for a in range(self.cursor, last, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with self._db() as db:
            yield from db.execute("SELECT seq, author_id, content FROM messages WHERE room = ? AND seq > ? AND seq <= ? AND deleted = 0 ORDER BY seq", [self.room, partition.low, partition.high])


class ReplicaStream(SimpleDataSourceStreamReader):
    """Offsets are seq, the order of arrival."""

    def __init__(self, options: dict) -> None:
        self.reader, self.batch = ReplicaReader(options), int(options.get("batch", 1000))

    def initialOffset(self) -> dict:
        return {"seq": self.reader.cursor}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        with self.reader._db() as db:
            rows = db.execute("SELECT seq, author_id, content FROM messages WHERE room = ? AND seq > ? AND deleted = 0 ORDER BY seq LIMIT ?", [self.reader.room, start["seq"], self.batch]).fetchall()
        return iter(rows), {"seq": rows[-1][0] if rows else start["seq"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.reader.read(Range(start["seq"], end["seq"]))


class ReplicaSource(DataSource):
    """spark.read.format("tidemark_replica") with path, room, cursor, now; also readStream."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_replica"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ReplicaReader(self.options)

    def simpleStreamReader(self, schema):
        return ReplicaStream(self.options)
