"""Operator 12: times as mixed text to UTC instants, by a dictionary of distinct stamps.

Distinct (source, zone, raw) are counted, parsed once, and their day-first and month-first
readings kept where both are possible. Slashed dates that can only be read one way vote, by their
counts, for that order in their source. Only undecided entries meet the votes, and the resolved
dictionary is joined back to the rows null-safely. Keys that hold more than a 256th of the rows (of the
undecided entries, for sources) are salted on both sides; there can be no more than 256 of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, partitions

# What a stamp may look like.
SPACE = " \t\n\x0b\x0c\r"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
Y, TWO = "(20[0-9][0-9])", "([0-9][0-9])"
TIME = rf"(?:[T\x20]{TWO}:{TWO}(?::{TWO})?(?:\x20?([AP]M))?(?:\x20?(?:(Z)|([+-]){TWO}:?{TWO}))?)?"
#: Patterns of dates, and the places of day, month and year among their groups.
DATES = [(re.compile(pattern + TIME), at) for pattern, at in (
    (rf"{Y}-{TWO}-{TWO}", (3, 2, 1)),
    (rf"{Y}{TWO}{TWO}", (3, 2, 1)),
    (rf"{TWO}\.{TWO}\.{Y}", (1, 2, 3)),
    (rf"{TWO} ({'|'.join(MONTHS)}) {Y}", (1, 2, 3)),
    (rf"{TWO}/{TWO}/{Y}", (1, 2, 3)),
)]
EPOCH = re.compile("[0-9]{10}|[0-9]{13}")
UNIX_DAY = datetime(1970, 1, 1).toordinal()
#: A key with more than this part of all rows is salted.
HEAVY = 256

Reading = tuple[int, bool] | None


@lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    """The zone of that name; None for null and unknown ones."""
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


def instant(day: int, month: int, year: int, clock: tuple[int, int, int], shift: int | None, zone: ZoneInfo | None) -> Reading:
    """(microseconds, odd) of a date and time: with an offset of `shift` seconds, else in the zone, whose skipped and repeated (odd) wall times take the offset before the change. None if there is no such date or zone."""
    odd = False
    try:
        wall = datetime(year, month, day, *clock)
    except ValueError:
        return None
    if shift is None:
        if zone is None:
            return None
        before, after = (wall.replace(tzinfo=zone, fold=fold).utcoffset() for fold in (0, 1))
        shift, odd = before.days * 86_400 + before.seconds, before != after
    seconds = (wall.toordinal() - UNIX_DAY) * 86_400 + clock[0] * 3600 + clock[1] * 60 + clock[2] - shift
    return seconds * 1_000_000, odd


def readings(raw: str | None, zone: str | None) -> tuple[str, Reading, Reading]:
    """kind (epoch, plain, slashed or bad), and the only reading, or of a slashed date the one with the day first and the one with the month first."""
    text = (raw or "").strip(SPACE)
    if EPOCH.fullmatch(text):
        return "epoch", (int(text) * (1_000_000 if len(text) == 10 else 1000), False), None
    m, at = next(((m, at) for pattern, at in DATES if (m := pattern.fullmatch(text))), (None, None))
    if m is None:
        return "bad", None, None
    day, month, year = (m[i] for i in at)
    month = MONTHS.index(month) + 1 if month.isalpha() else int(month)
    hour, minute, second, half, utc, sign, oh, om = m.groups()[3:]
    hour, minute, second = int(hour or 0), int(minute or 0), int(second or 0)
    if half:
        if not 1 <= hour <= 12:
            return "bad", None, None
        hour = hour % 12 + 12 * (half == "PM")
    if hour > 23 or minute > 59 or second > 59 or int(oh or 0) > 14 or int(om or 0) > 59:
        return "bad", None, None
    shift = 0 if utc else (int(oh) * 3600 + int(om) * 60) * (-1 if sign == "-" else 1) if sign else None
    zoned, clock = zone_of(zone), (hour, minute, second)
    first = instant(int(day), month, int(year), clock, shift, zoned)
    if at[0] == 1 and text[2] == "/":
        second_ = instant(month, int(day), int(year), clock, shift, zoned)
        return ("slashed", first, second_) if first or second_ else ("bad", None, None)
    return ("plain", first, None) if first else ("bad", None, None)


def parsed(entries: DataFrame) -> DataFrame:
    """(source, zone, raw, n) with kind, first_us, first_odd, second_us and second_odd, the two readings of `readings`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [readings(raw, zone) for raw, zone in zip(batch.column("raw").to_pylist(), batch.column("zone").to_pylist(), strict=True)]
            out = [pa.array([f[0] for f in found], pa.string())]
            for which in (1, 2):
                out += [pa.array([f[which] and f[which][i] for f in found], t) for i, t in enumerate((pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, "kind", "first_us", "first_odd", "second_us", "second_odd"])

    return entries.select("source", "zone", "raw", "n").mapInArrow(run, "source string, zone string, raw string, n long, kind string, first_us long, first_odd boolean, second_us long, second_odd boolean")


def _salted(left: DataFrame, right: DataFrame, keys: list[str], rows: int, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with _salt: of keys that counts (a hash of the keys as _h, and n) finds heavy, left rows are dealt over salts and right rows repeated for each.

    Heavy hashes are fewer than HEAVY, since each has over 1/HEAVY of all rows; only these are broadcast.
    """
    n = partitions(left.sparkSession)
    heavy = F.broadcast(counts.where(F.col("n") * HEAVY > rows).select("_h", F.least(F.ceil(F.col("n") * n * 4 / max(rows, 1)), F.lit(n)).cast("int").alias("_salts")))
    left = left.withColumn("_h", F.xxhash64(*keys)).join(heavy, "_h", "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("int")).drop("_h", "_salts")
    right = right.withColumn("_h", F.xxhash64(*keys)).join(heavy, "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_h", "_salts")
    return left, right


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe left join on keys and _salt; neither side is broadcast, as both grow with the input."""
    right = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate([*keys, "_salt"])})
    same = F.lit(True)
    for i, k in enumerate([*keys, "_salt"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    return left.join(right.hint("merge"), same, "left").drop("_salt", *(f"_r{i}" for i in range(len(keys) + 1)))


def resolved(entries: DataFrame) -> DataFrame:
    """(source, zone, raw, n) with utc_us, rule and ambiguous: every entry parsed, undecided ones by the votes of their source."""
    read = durable(parsed(entries))
    first, second = F.col("first_us"), F.col("second_us")
    undecided = (F.col("kind") == "slashed") & first.isNotNull() & second.isNotNull() & F.coalesce(first != second, F.lit(False))
    decided = read.where(~undecided).select("source", "zone", "raw", "n", F.coalesce(first, second).alias("utc_us"), F.when(F.col("kind").isin("bad", "epoch"), F.col("kind")).otherwise("plain").alias("rule"), F.coalesce("first_odd", "second_odd", F.lit(False)).alias("ambiguous"))
    alone = (F.col("kind") == "slashed") & (first.isNull() | second.isNull())
    votes = read.where(alone).groupBy("source").agg(F.sum(F.when(second.isNull(), F.col("n")).otherwise(0)).alias("day_first"), F.sum(F.when(first.isNull(), F.col("n")).otherwise(0)).alias("month_first"))
    open_ = read.where(undecided)
    counts = open_.groupBy(F.xxhash64("source").alias("_h")).agg(F.count("*").alias("n"))
    left, right = _salted(open_, votes, ["source"], open_.count(), counts)
    judged = _matched(left, right, ["source"])
    days, months = F.coalesce("day_first", F.lit(0)), F.coalesce("month_first", F.lit(0))
    judged = judged.select("source", "zone", "raw", "n", F.when(days > months, first).otherwise(second).alias("utc_us"), F.when(days == months, "default").otherwise("votes").alias("rule"), F.lit(True).alias("ambiguous"))
    return decided.unionByName(judged)


def normalise_stamps(df: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw") -> DataFrame:
    """One row for each row of df: id, utc_us, rule (bad, epoch, votes, default or plain), ambiguous.

    Null, empty and other texts that are no possible stamp are bad, however long; so are wall times
    of a null or unknown zone. Sources that are null are one source. Equal rows have equal results,
    ids aside; ids may repeat or be null. Ties of votes, none included, read the month first. An
    empty table gives an empty table; other columns don't matter, whatever they are called.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), F.col(zone_col).cast("string").alias("zone"), F.col(raw_col).cast("string").alias("raw"))
    keys = ["source", "zone", "raw"]
    entries = durable(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    total = entries.agg(F.sum("n")).first()[0] or 0
    counts = entries.where(F.col("n") * HEAVY > total).groupBy(F.xxhash64(*keys).alias("_h")).agg(F.sum("n").alias("n"))
    left, right = _salted(rows, resolved(entries).drop("n"), keys, total, counts)
    return _matched(left, right, keys).select(F.col("_id").alias(id_col), "utc_us", "rule", "ambiguous")
