"""Registered queries over the shop's tables: histories of clients as records, sessions of clicks as walks and polls."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import pages as P
from tidemark.operators import merge, places, pointers
from tidemark.plans import views as W
from tidemark.plans.registry import query
from tidemark.schema import MIN_DESCRIBABLE
from tidemark.streaming import lww

# ---- client_changes as records: a peer last saw what was valid before March
MARCH = "2024-03-01 00:00:00"
HISTORY_SQL = f"""
WITH v AS (SELECT client_id, change_id, seq AS version, op = 'D' AS is_tomb, sha256(CAST(change_id AS VARCHAR)) AS sig, valid_at, source, coalesce(segment, '?') AS state FROM client_changes),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY version DESC NULLS LAST, is_tomb DESC NULLS LAST, sig DESC) = 1),
p AS (SELECT * FROM v WHERE valid_at < TIMESTAMP '{MARCH}' QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY version DESC NULLS LAST, is_tomb DESC NULLS LAST, sig DESC) = 1)
"""


def state() -> Column:
    return F.coalesce("segment", F.lit("?")).alias("state")


def history(changes: DataFrame) -> DataFrame:
    """client_changes as versions of clients; a deletion is a tombstone, a change's id stands for its signature."""
    return changes.select("client_id", "change_id", F.col("seq").alias("version"), (F.col("op") == "D").alias("is_tomb"), F.sha2(F.col("change_id").cast("string"), 256).alias("sig"), "valid_at", "source", state())


def _histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All versions, and those that the peer saw."""
    versions = history(W.table(spark, sf_dir, "client_changes"))
    return versions, versions.where(F.col("valid_at") < F.lit(MARCH).cast("timestamp_ntz"))


@query(f"""{HISTORY_SQL} SELECT w.client_id, w.version, w.is_tomb, w.state FROM w LEFT JOIN p ON w.client_id = p.client_id
WHERE p.version IS NULL OR w.version > p.version OR (w.version = p.version AND substr(w.sig, 1, 8) <> substr(p.sig, 1, 8))""")
def client_catch_up(spark, sf_dir):
    """What the peer lacks of the clients' last states: unknown clients, newer versions, other changes of the same version."""
    versions, seen = _histories(spark, sf_dir)
    summary = merge.summarize_records(merge.latest(seen, "client_id"), ("client_id",))
    return merge.delta_records(merge.latest(versions, "client_id"), summary, ("client_id",)).select("client_id", "version", "is_tomb", "state")


@query(f"""{HISTORY_SQL}, o AS (SELECT client_id AS app_id, updated_at, coalesce(segment, '?') AS state FROM clients)
SELECT app_id, CASE WHEN w.client_id IS NULL OR (NOT is_tomb AND valid_at IS NULL) THEN 'refuse' WHEN is_tomb THEN 'put' WHEN o.state = w.state THEN 'skip' WHEN updated_at > valid_at THEN 'update' ELSE 'refuse' END AS decision
FROM o LEFT JOIN w ON app_id = w.client_id""")
def client_publish(spark, sf_dir):
    """Whether each row of clients may be written over what its history says: absent after a deletion, unclear without a time."""
    versions, _ = _histories(spark, sf_dir)
    status = F.when(F.col("is_tomb"), "absent").when(F.col("valid_at").isNull(), "unclear").otherwise("present")
    there = merge.latest(versions, "client_id").select(F.col("client_id").alias("app_id"), status.alias("status"), F.col("valid_at").alias("version"), "state")
    own = W.table(spark, sf_dir, "clients").select(F.col("client_id").alias("app_id"), F.col("updated_at").alias("version"), state())
    return pointers.publish_decision(own, there)


@query(f"""{HISTORY_SQL}, h AS (SELECT * FROM v WHERE valid_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY valid_at DESC, change_id DESC) = 1)
SELECT h.client_id AS app_id, CASE WHEN h.source IS NULL OR c.source IS NULL OR h.source <> c.source THEN 'hash' WHEN p.state IS NOT NULL AND h.state <> p.state AND h.version <= p.version THEN 'version not raised' END AS reason
FROM h LEFT JOIN p ON h.client_id = p.client_id LEFT JOIN clients AS c ON h.client_id = c.client_id""")
def client_freshness(spark, sf_dir):
    """Faults of each client's last change by time: another source than in clients, or changed since the peer's version without a higher one."""
    versions, seen = _histories(spark, sf_dir)
    last = versions.where("valid_at IS NOT NULL").groupBy(F.col("client_id").alias("app_id")).agg(F.max_by(F.struct("version", "state", "source"), F.struct("valid_at", "change_id")).alias("_last")).select("app_id", "_last.*")
    filed = W.table(spark, sf_dir, "clients").select(F.col("client_id").alias("app_id"), F.sha2("source", 256).alias("actual_hash"))
    head = last.withColumn("code_hash", F.sha2("source", 256)).join(filed, "app_id", "left").drop("source")
    base = merge.latest(seen, "client_id").select(F.col("client_id").alias("app_id"), "version", "state")
    return pointers.paired(base, head).select("app_id", pointers.freshness_reason().alias("reason"))


@query(f"{HISTORY_SQL} SELECT client_id, version, is_tomb, sig, state FROM w")
def stream_client_changes(spark, sf_dir):
    """The clients' last states by a supervised stream that keeps winners in a state store and hands on changes only."""
    folder = f"{places.shared_folder(spark)}/clients_{uuid.uuid4().hex}"
    places.remove(spark, folder, at_exit=True)
    rows = history(W.streamed(spark, sf_dir, "client_changes")).select("client_id", "version", "is_tomb", "sig", "state")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        lww.supervised(lambda: lww.into_changes(rows, f"{folder}/changes", f"{folder}/stream", "client_id"), tries=3)
    finally:
        spark.conf.set(store, before)
    return lww.winners(spark, f"{folder}/changes", rows.schema, "client_id")


# ---- clicks of a client and a day as what a page showed
SESSION_SQL = "coalesce(CAST(client_id AS VARCHAR), '?') || '/' || CAST(CAST(ts AS DATE) AS VARCHAR)"


def session() -> Column:
    return F.concat(F.coalesce(F.col("client_id").cast("string"), F.lit("?")), F.lit("/"), F.col("ts").cast("date").cast("string")).alias("resource")


@query(f"""
WITH RECURSIVE c AS (SELECT {SESSION_SQL} AS resource, ts, click_id, '#/' || kind || '/' || regexp_extract(coalesce(props, ''), '"k": [0-9]*([0-9])', 1) AS hash FROM clicks WHERE ts IS NOT NULL),
n AS (SELECT resource, hash, row_number() OVER (PARTITION BY resource ORDER BY ts, click_id) AS step FROM c), s AS (SELECT resource, list(hash ORDER BY step) AS h FROM n WHERE step <= {P.WALK_CAP + 1} GROUP BY resource),
w AS (
  SELECT resource, h, 1 AS n, [h[1]] AS pages, false AS again, CAST(NULL AS BOOLEAN) AS partial FROM s
  UNION ALL
  SELECT resource, h, n + 1, CASE WHEN n <= {P.WALK_PAGES} AND n < len(h) AND h[n + 1] IS NOT NULL AND h[n + 1] IS DISTINCT FROM h[1] AND NOT list_contains(pages[2:], h[n + 1]) THEN list_append(pages, h[n + 1]) ELSE pages END,
    again OR coalesce(h[n + 1] = h[1], false),
    CASE WHEN n > {P.WALK_PAGES} OR n >= len(h) THEN false WHEN h[n + 1] IS NULL THEN true WHEN h[n + 1] = h[1] THEN CASE WHEN again THEN false END WHEN list_contains(pages[2:], h[n + 1]) THEN false END
  FROM w WHERE partial IS NULL
)
SELECT resource, array_to_string(list_transform(pages, lambda x: coalesce(x, '?')), ',') AS pages, partial FROM w WHERE partial IS NOT NULL""")
def click_walks(spark, sf_dir):
    """Walks over what a client clicked on a day: the kind and the last digit of k name a page, without a kind it can't be read."""
    clicks = W.table(spark, sf_dir, "clicks").where("ts IS NOT NULL")
    digit = F.regexp_extract(F.coalesce("props", F.lit("")), '"k": [0-9]*([0-9])', 1)
    by = Window.partitionBy("resource").orderBy("ts", "click_id")
    steps = clicks.select(session(), "ts", "click_id", F.concat(F.lit("#/"), "kind", F.lit("/"), digit).alias("hash")).withColumn("step", F.row_number().over(by) - 1)
    return P.walked_pages(steps).select("resource", F.array_join("pages", ",", "?").alias("pages"), "partial")


#: What the clicks of one second amount to as a poll.
POLL = (
    "max(CASE WHEN value > 20 THEN 100 ELSE 0 END) AS length",
    "max(CASE WHEN props LIKE '%sku%' THEN 1 ELSE 0 END) AS anchors",
    "max(CASE WHEN kind IN ('view', 'click') THEN 300 ELSE 10 END) AS size",
    "coalesce(bool_or(kind = 'error'), false) AS waiting",
)


@query(f"""
WITH c AS (SELECT {SESSION_SQL} AS resource, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS sec, value, props, kind FROM clicks WHERE ts IS NOT NULL),
s AS (SELECT resource, sec, {', '.join(POLL)} FROM c GROUP BY ALL), m AS (SELECT *, sec - min(sec) OVER (PARTITION BY resource) AS ms FROM s),
f AS (SELECT *, coalesce(ms > {P.SETTLE_AFTER} AND (length, anchors, size) = lag((length, anchors, size)) OVER o AND (length > {P.LEAST_TEXT} OR anchors > 0) AND NOT (waiting AND size < {MIN_DESCRIBABLE}), false) AS flat FROM m WINDOW o AS (PARTITION BY resource ORDER BY ms)),
g AS (SELECT *, flat AND coalesce(lag(flat) OVER (PARTITION BY resource ORDER BY ms), false) AS still FROM f),
e AS (SELECT resource, min(CASE WHEN still OR ms > {P.POLL_UNTIL} THEN ms END) AS ms FROM g GROUP BY resource)
SELECT e.resource, e.ms, coalesce(g.still, false) AS settled FROM e LEFT JOIN g ON e.resource = g.resource AND e.ms = g.ms""")
def click_settling(spark, sf_dir):
    """When a client's day settles, its clicks read as polls a second for each millisecond: two polls in a row that show what the one before did."""
    clicks = W.table(spark, sf_dir, "clicks").where("ts IS NOT NULL")
    polls = clicks.withColumn("sec", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")).groupBy(session(), "sec").agg(*map(F.expr, POLL))
    ms = F.col("sec") - F.min("sec").over(Window.partitionBy("resource"))
    return P.settled(polls.withColumn("ms", ms), "resource")
