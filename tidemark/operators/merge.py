"""The merge algebra: last write wins with tombstones, summaries and deltas.

A state is three DataFrames, records, key_auth and registry. Merging is a union and one
aggregate on the subject, with partial aggregation before the only shuffle, so a subject with
very many versions is reduced where its rows lie.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.schema import KEY_AUTH, RECORDS, REGISTRY


@dataclass(frozen=True)
class State:
    """An index: records, key_auth (no row or one) and registry (no row or one)."""

    records: DataFrame
    key_auth: DataFrame
    registry: DataFrame


def empty_state(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], RECORDS), spark.createDataFrame([], KEY_AUTH), spark.createDataFrame([], REGISTRY))


def latest(records: DataFrame, key: str | list[str] = "subject_id") -> DataFrame:
    """For each key the row with the greatest (version, is_tomb, sig)."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in records.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct("version", "is_tomb", "sig")).alias("_best")
    return records.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*records.columns)


def pick_registry(registries: DataFrame) -> DataFrame:
    """The registry with the greatest (version, sig) of each index; no row never clears one."""
    others = [c for c in registries.columns if c != "index_slug"]
    best = F.max_by(F.struct(*others), F.struct("version", "sig")).alias("_best")
    return registries.groupBy("index_slug").agg(best).select("index_slug", "_best.*").select(*registries.columns)


def pick_key_auth(auths: DataFrame) -> DataFrame:
    """The one with the least signature, so that all replicas choose alike; no row if there is none."""
    best = F.min_by(F.struct(*auths.columns), F.col("sig")).alias("_best")
    return auths.agg(best).where("_best is not null").select("_best.*")


def fold(states: list[State]) -> State:
    """All states merged at once: commutative, associative, idempotent."""
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return State(latest(union([s.records for s in states])), pick_key_auth(union([s.key_auth for s in states])), pick_registry(union([s.registry for s in states])))


def merge(a: State, b: State) -> State:
    return fold([a, b])


def count_live_tomb(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(~F.col("is_tomb")).alias("live"), F.count_if("is_tomb").alias("tombstones"))


def summarize_records(records: DataFrame, key: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """The key, version and fp, the first bytes of the signature."""
    return records.select(*key, "version", C.fingerprint().alias("fp"))


def summarize_head(state: State) -> DataFrame:
    """One row: versions of key_auth and registry (0 if there is none), the registry's fingerprint (zeros)."""
    auth = state.key_auth.agg(F.coalesce(F.max("version"), F.lit(0)).alias("key_auth_version"))
    apps = state.registry.agg(F.coalesce(F.max("version"), F.lit(0)).alias("apps_version"), F.coalesce(F.max_by(C.fingerprint(), "version"), F.unhex(F.lit("00" * 8))).alias("apps_fp"))
    return auth.crossJoin(apps)  # one row each


def delta_records(records: DataFrame, summary: DataFrame, key: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Rows that the summary lacks, has older, or has at the same version with another, known fingerprint."""
    theirs = summary.select(*key, F.col("version").alias("_version"), F.col("fp").alias("_fp"))
    newer = F.col("_version").isNull() | (F.col("version") > F.col("_version"))
    other = (F.col("version") == F.col("_version")) & F.col("_fp").isNotNull() & (F.col("_fp") != C.fingerprint())
    return records.join(theirs, list(key), "left").where(newer | other).select(*records.columns)


def delta(state: State, summary: DataFrame, head: dict) -> State:
    """What a peer with this summary lacks: key_auth if newer, the registry if newer or differing, records."""
    auth = state.key_auth.where(F.col("version") > head["key_auth_version"])
    differs = (F.col("version") == head["apps_version"]) & (C.fingerprint() != F.lit(bytes(head["apps_fp"])))
    return State(delta_records(state.records, summary), auth, state.registry.where((F.col("version") > head["apps_version"]) | differs))


def is_empty_delta(d: State) -> bool:
    """An empty delta is sent and taken as no bytes."""
    return d.records.isEmpty() and d.key_auth.isEmpty() and d.registry.isEmpty()


def anti_entropy(mine: State, theirs: State) -> State:
    """One exchange: theirs after it has taken what it lacks of mine."""
    head = summarize_head(theirs).first().asDict()
    d = delta(mine, summarize_records(theirs.records), head)
    return theirs if is_empty_delta(d) else merge(theirs, d)


def with_records(state: State, records: DataFrame) -> State:
    return replace(state, records=records)


def duplicate_probe(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates whose dedup key is listed already, with the first subject that has it."""
    listed = entries.groupBy(C.dedup_key().alias("_key")).agg(F.min("subject_id").alias("listed_as"))
    return candidates.withColumn("_key", C.dedup_key()).join(listed, "_key").drop("_key")


def without_duplicates(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates that may be added."""
    listed = entries.select(C.dedup_key().alias("_key"))
    return candidates.withColumn("_key", C.dedup_key()).join(listed, "_key", "left_anti").drop("_key")


def point_lookup(records: DataFrame, subject_id: str, key: str = "filed_as") -> DataFrame:
    """The record filed under an id, if its body says the same id."""
    return records.where((F.col(key) == subject_id) & (F.col("subject_id") == subject_id))


def not_acknowledged(missing: DataFrame, acks: DataFrame, on: str = "generation") -> DataFrame:
    return missing.join(acks.select(on), on, "left_anti")
