"""Checks over a small set of published pointer records, paired by app id and never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vanished(base: DataFrame, head: DataFrame) -> DataFrame:
    """Records of base that head no longer has, by the exact id."""
    return base.join(head.select("app_id"), "app_id", "left_anti")


def paired(base: DataFrame, head: DataFrame) -> DataFrame:
    old = base.select("app_id", *(F.col(c).alias(f"old_{c}") for c in base.columns if c != "app_id"))
    return head.join(old, "app_id", "left")


def freshness_reason(signed: Column | None = None) -> Column:
    """First fault of a paired record: its hash isn't the file's, its signature is bad, or it changed without a higher version.

    signed tells whether the record's signature holds, as signature_ok does; what can't be told
    counts as a fault.
    """
    changed = F.col("old_state").isNotNull() & ~F.col("state").eqNullSafe(F.col("old_state"))
    raised = F.coalesce(F.col("version") > F.col("old_version"), F.lit(False))
    return F.coalesce(
        F.when(~F.coalesce(F.col("code_hash") == F.col("actual_hash"), F.lit(False)), "hash"),
        F.lit(None).cast("string") if signed is None else F.when(~F.coalesce(signed, F.lit(False)), "signature"),
        F.when(changed & ~raised, "version not raised"),
    )


def publish_decision(own: DataFrame, published: DataFrame) -> DataFrame:
    """skip if equal, put if proven absent, update if strictly newer, else refuse.

    published has status `present`, `absent` or `unclear`, with version and state if present.
    """
    there = published.select("app_id", F.col("status").alias("_status"), F.col("version").alias("_version"), F.col("state").alias("_state"))
    decision = (
        F.when((F.col("_status") == "present") & (F.col("state") == F.col("_state")), "skip")
        .when(F.col("_status") == "absent", "put")
        .when((F.col("_status") == "present") & (F.col("version") > F.col("_version")), "update")
        .otherwise("refuse")
    )
    return own.join(there, "app_id", "left").select("app_id", decision.alias("decision"))


def read_back(written: DataFrame, found: DataFrame) -> DataFrame:
    """verified, unverified (found, but other) or not written."""
    there = found.select("app_id", F.col("version").alias("_version"), F.col("state").alias("_state"), F.col("code_hash").alias("_hash"))
    same = (F.col("version") == F.col("_version")) & (F.col("state") == F.col("_state")) & (F.col("code_hash") == F.col("_hash"))
    return written.join(there, "app_id", "left").select("app_id", F.when(F.col("_version").isNull(), "not written").when(same, "verified").otherwise("unverified").alias("outcome"))


def all_green(runs: DataFrame, ok: Column) -> DataFrame:
    """Whether there are runs and none is bad: no runs at all isn't green."""
    return runs.agg(((F.count("*") > 0) & (F.count_if(~ok) == 0)).alias("green"))


def green_of(groups: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, green) for each group: whether it has runs and none is bad (`ok` false or null), in one aggregate."""
    told = runs.groupBy(key).agg((F.count_if(~F.coalesce("ok", F.lit(False))) == 0).alias("green"))
    return groups.join(told, key, "left").select(key, F.coalesce("green", F.lit(False)).alias("green"))


def anchored(lines: DataFrame, key: str) -> bool:
    """Whether a key stands alone on a line."""
    return not lines.where(F.col("value") == key).isEmpty()
