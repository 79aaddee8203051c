"""The registered queries over the synthetic tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import html as H
from tidemark.functions import pages as P
from tidemark.functions import validate as V
from tidemark.operators import dml, merge, places, pointers, search
from tidemark.plans import views as W
from tidemark.plans.registry import query
from tidemark.schema import CLASS, MAX_RECONCILE_AGE, U64
from tidemark.sources import messages as M
from tidemark.streaming.lww import into_snapshots, last_snapshot

# ---- browse and search
CARD = ("rn", "subject_id", "title", "kind_label", "adult_sections", "href", "host_app", "target")


def cards_sql(where: str) -> str:
    return f"""{W.ENTRIES_SQL} SELECT row_number() OVER (ORDER BY featured DESC, added_at DESC, subject_id) AS rn, subject_id, title,
      CASE kind WHEN 'App' THEN 'app' ELSE 'site' END AS kind_label, judged AND toxic AS adult_sections, href, host_app,
      CASE WHEN variant = 1 THEN '_blank' ELSE '_self' END AS target FROM r WHERE {where}"""


def found_sql(term: str) -> str:
    return f"(contains(lower(title), '{term}') OR contains(lower(snippet), '{term}') OR contains(lower(lang), '{term}') OR contains(lower(source), '{term}'))"


SAFE_SQL = "(NOT judged OR NOT toxic)"


def _cards(spark, sf_dir, term="", safe=True):
    found = search.found(W.entries(spark, sf_dir), W.apps(spark), term, safe)
    return search.numbered(found.select(*CARD[1:], "featured", "added_at")).select(*CARD)


@query(cards_sql(SAFE_SQL))
def browse_safe(spark, sf_dir):
    return _cards(spark, sf_dir)


@query(cards_sql("true"))
def browse_all(spark, sf_dir):
    return _cards(spark, sf_dir, safe=C.safe_preference("off"))


@query(cards_sql(f"{SAFE_SQL} AND {found_sql('tion')}"))
def search_term(spark, sf_dir):
    return _cards(spark, sf_dir, "TION")


@query(cards_sql(f"{SAFE_SQL} AND {found_sql('%')}"))
def search_literal_percent(spark, sf_dir):
    return _cards(spark, sf_dir, "%")


@query(cards_sql(f"{SAFE_SQL} AND {found_sql('src1')}"))
def search_tag(spark, sf_dir):
    return _cards(spark, sf_dir, "src1")


@query(f"{W.ENTRIES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE {found_sql('tion')}) AS shown, CAST(count(*) FILTER (WHERE {found_sql('tion')}) AS VARCHAR) || ' results' AS line FROM r WHERE {SAFE_SQL}")
def search_counts(spark, sf_dir):
    return search.counts(W.entries(spark, sf_dir), "tion")


@query(f"{W.ENTRIES_SQL} SELECT row_number() OVER (ORDER BY added_at DESC, subject_id) AS rn, subject_id, added_at FROM r")
def list_recent(spark, sf_dir):
    return search.listed(W.entries(spark, sf_dir).select("subject_id", F.col("added_at").cast("long").alias("added_at")))


# ---- projections and joins
@query(f"{W.ENTRIES_SQL} SELECT subject_id, uri, dedup_key FROM r")
def locator_uri(spark, sf_dir):
    return W.entries(spark, sf_dir).select("subject_id", C.locator_uri().alias("uri"), C.dedup_key().alias("dedup_key"))


@query(f"{W.ENTRIES_SQL} SELECT subject_id, href, host_app FROM r")
def resolve_href(spark, sf_dir):
    return C.with_href(W.entries(spark, sf_dir), W.apps(spark)).select("subject_id", "href", "host_app")


@query(f"{W.ENTRIES_SQL} SELECT subject_id, CASE kind WHEN 'App' THEN 'app' ELSE 'site' END AS label, CASE WHEN variant = 1 THEN '_blank' ELSE '_self' END AS target, judged AND toxic AS adult FROM r")
def labels_and_badges(spark, sf_dir):
    return W.entries(spark, sf_dir).select("subject_id", C.kind_label().alias("label"), C.link_target().alias("target"), C.has_adult_sections().alias("adult"))


@query(f"{W.ENTRIES_SQL} SELECT subject_id, source AS app FROM r WHERE href IS NULL")
def unresolvable(spark, sf_dir):
    return search.unresolvable(W.entries(spark, sf_dir), W.apps(spark)).select("subject_id", F.col("locator.app").alias("app"))


@query(f"{W.ENTRIES_SQL} SELECT subject_id FROM r WHERE NOT judged")
def unclassified(spark, sf_dir):
    return search.unclassified(W.entries(spark, sf_dir)).select("subject_id")


@query(f"{W.ENTRIES_SQL} SELECT count(*) AS live, count(*) FILTER (WHERE href IS NULL) AS unresolvable, count(*) FILTER (WHERE NOT judged) AS unclassified FROM r")
def work_counts(spark, sf_dir):
    return search.work_counts(W.entries(spark, sf_dir), W.apps(spark))


@query(f"{W.ENTRIES_SQL} SELECT subject_id, CASE WHEN NOT judged THEN '     class: NOT CLASSIFIED' ELSE '     class: ' || CASE WHEN toxic THEN 'adult landing, has' ELSE 'general landing, no' END || ' adult sections, static (classifier 0, at {W.NOW})' END AS line FROM r")
def metadata_lines(spark, sf_dir):
    return W.entries(spark, sf_dir).select("subject_id", C.metadata_lines().alias("line"))


CLASS_JSON_SQL = f"""CASE WHEN judged THEN '{{"landing":"' || CASE WHEN toxic THEN 'adult' ELSE 'general' END || '","has_adult_sections":' || CASE WHEN toxic THEN 'true' ELSE 'false' END || ',"volatility":"static","classifier":0,"classified_at":{W.NOW}}}' ELSE 'null' END"""


@query(f"""{W.ENTRIES_SQL} SELECT subject_id, '{{"subject_id":"' || subject_id || '","version":1,"kind":"' || kind || '","title":' || CAST(to_json(title) AS VARCHAR) || ',"locator":"' || uri
  || '","featured":' || CASE WHEN featured THEN 'true' ELSE 'false' END || ',"added_at":' || CAST(added_at AS VARCHAR) || ',"class":' || {CLASS_JSON_SQL} || ',"verified":null,"ext":null}}' AS line FROM r""")
def listing_json(spark, sf_dir):
    return search.listing_json(W.entries(spark, sf_dir))


CLASS_LINE_SQL = f"CASE WHEN NOT judged THEN '     class: NOT CLASSIFIED' ELSE '     class: ' || CASE WHEN toxic THEN 'adult landing, has' ELSE 'general landing, no' END || ' adult sections, static (classifier 0, at {W.NOW})' END"


@query(f"""{W.ENTRIES_SQL} SELECT subject_id, CASE WHEN featured THEN '★ ' ELSE '  ' END || subject_id || '  [' || kind || ']  ' || title || chr(10) || '     ' || snippet || chr(10) || '     ' || uri
  || CASE WHEN href IS NULL THEN '  [UNRESOLVABLE: app not in registry]' ELSE '' END || chr(10) || {CLASS_LINE_SQL} AS line FROM r""")
def listing_text(spark, sf_dir):
    return search.listing_text(W.entries(spark, sf_dir), W.apps(spark))


@query(f"""{W.ENTRIES_SQL} SELECT subject_id, {CLASS_LINE_SQL} || CASE WHEN n % 2 = 0 THEN chr(10) || '     verified: ok at ' || CAST(n AS VARCHAR) ELSE '' END || CASE WHEN n % 3 = 0 THEN chr(10) || '     ext: a=' || lang || '  b=x=' ELSE '' END AS line FROM r""")
def metadata_lines_full(spark, sf_dir):
    """Entries with a verification (even numbers) and extensions (every third)."""
    n = W.number("subject_id")
    e = W.entries(spark, sf_dir).withColumn("verified", F.when(n % 2 == 0, F.struct(n.cast(U64).alias("last_verified_at"), F.lit("ok").alias("status"))))
    e = e.withColumn("ext", F.when(n % 3 == 0, F.create_map(F.lit("b"), F.lit("x="), F.lit("a"), F.col("tags")[0])))
    return e.select("subject_id", C.metadata_lines().alias("line"))


@query(f"""{W.ENTRIES_SQL} SELECT subject_id, CASE n % 4 WHEN 0 THEN {W.NOW} WHEN 1 THEN 7 END AS last_verified_at, CASE n % 4 WHEN 0 THEN 'gone' WHEN 1 THEN 'ok' END AS status FROM r""")
def verified_rule(spark, sf_dir):
    """A status is stamped, an unchanged description keeps, a changed one clears, nothing stays nothing."""
    n = F.pmod(W.number("subject_id"), F.lit(4))
    current = F.when(n != 3, F.struct(F.lit(7).cast(U64).alias("last_verified_at"), F.lit("ok").alias("status")))
    got = W.entries(spark, sf_dir).select("subject_id", C.next_verified(current, F.when(n == 0, "gone"), n == 2, W.NOW).alias("v"))
    return got.select("subject_id", F.col("v.last_verified_at").cast("long").alias("last_verified_at"), F.col("v.status").alias("status"))


# ---- merge
ROW = ("user_id", "version", "is_tomb", "sig")
ROW_SQL = "user_id, version, is_tomb, sig"


@query(f"{W.RECORDS_SQL} SELECT {ROW_SQL} FROM w")
def lww_latest(spark, sf_dir):
    return merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id")


@query(f"{W.RECORDS_SQL} SELECT {ROW_SQL} FROM w WHERE NOT is_tomb")
def lww_live(spark, sf_dir):
    return merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id").where(~F.col("is_tomb"))


@query(f"{W.RECORDS_SQL} SELECT {ROW_SQL} FROM (SELECT {ROW_SQL} FROM w WHERE generation < 2 UNION ALL SELECT {ROW_SQL} FROM p) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC, is_tomb DESC, sig DESC) = 1")
def merge_two(spark, sf_dir):
    mine = merge.latest(W.records(spark, sf_dir), "user_id").where("generation < 2").select(*ROW)
    return merge.latest(mine.unionByName(W.peer(spark, sf_dir).select(*ROW)), "user_id")


@query(f"{W.RECORDS_SQL} SELECT {ROW_SQL} FROM w")
def fold_generations(spark, sf_dir):
    """Each generation's winners, then the fold of all: the same as the winners of everything."""
    each = merge.latest(W.records(spark, sf_dir).select(F.concat_ws("/", "generation", "user_id").alias("k"), *ROW), "k").drop("k")
    return merge.latest(each, "user_id")


@query(f"{W.RECORDS_SQL} SELECT count(*) FILTER (WHERE NOT is_tomb) AS live, count(*) FILTER (WHERE is_tomb) AS tombstones FROM w")
def count_live_tomb(spark, sf_dir):
    return merge.count_live_tomb(merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id"))


@query(f"{W.RECORDS_SQL} SELECT user_id AS subject_id, version, substr(sig, 1, 8) AS fp FROM w")
def summarize(spark, sf_dir):
    return merge.summarize_records(merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id").withColumnRenamed("user_id", "subject_id"))


def _delta(spark, sf_dir, fp):
    mine = merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id").withColumnRenamed("user_id", "subject_id")
    theirs = W.peer(spark, sf_dir).select(F.col("user_id").alias("subject_id"), "version", fp.alias("fp"))
    return merge.delta_records(mine, theirs)


DELTA_SQL = W.RECORDS_SQL + "SELECT w.user_id AS subject_id, w.version, w.is_tomb, w.sig FROM w LEFT JOIN p USING (user_id) WHERE p.user_id IS NULL OR w.version > p.version"


@query(DELTA_SQL + " OR (w.version = p.version AND w.user_id % 10 <> 0 AND substr(w.sig, 1, 8) <> substr(p.sig, 1, 8))")
def delta_records(spark, sf_dir):
    return _delta(spark, sf_dir, F.when(F.col("user_id") % 10 != 0, C.fingerprint()))


@query(DELTA_SQL)
def delta_legacy_summary(spark, sf_dir):
    return _delta(spark, sf_dir, F.lit(None).cast("string"))


@query(f"{W.RECORDS_SQL} SELECT count(*) AS records, 0 AS lacking, count(*) FILTER (WHERE user_id % 3 = 0) AS lacking_a_third FROM w")
def delta_converged_empty(spark, sf_dir):
    """A peer with the same records lacks none; one without a third of them lacks these."""
    mine = merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id").withColumnRenamed("user_id", "subject_id")
    count = lambda theirs, name: merge.delta_records(mine, merge.summarize_records(theirs)).agg(F.count("*").alias(name))
    return mine.agg(F.count("*").alias("records")).crossJoin(count(mine, "lacking")).crossJoin(count(mine.where("subject_id % 3 <> 0"), "lacking_a_third"))  # one row each


@query(f"{W.RECORDS_SQL} SELECT user_id % 10 AS index_slug, version, sig FROM v QUALIFY row_number() OVER (PARTITION BY user_id % 10 ORDER BY version DESC, sig DESC) = 1")
def registry_pick(spark, sf_dir):
    return merge.pick_registry(W.records(spark, sf_dir).select((F.col("user_id") % 10).alias("index_slug"), "version", "sig"))


@query(f"{W.RECORDS_SQL} SELECT version, sig FROM v ORDER BY sig LIMIT 1")
def keyauth_pick(spark, sf_dir):
    return merge.pick_key_auth(W.records(spark, sf_dir).select("version", "sig"))


def _candidates(spark, sf_dir):
    """Every entry again, under another path, and as many new ones."""
    e = W.entries(spark, sf_dir)
    moved = F.col("locator").withField("path", F.when(F.col("locator.variant") == "AppResource", "/new").otherwise(F.col("locator.path")))
    return e.select(F.concat(F.lit("n"), "subject_id").alias("candidate"), moved.alias("locator")).union(
        e.select(F.concat(F.lit("o"), "subject_id").alias("candidate"), F.col("locator").withField("variant", F.lit("External")).withField("url", F.concat(F.lit("https://new/"), "subject_id")).alias("locator"))
    )


CANDIDATES_SQL = W.ENTRIES_SQL + ", k AS (SELECT 'n' || subject_id AS candidate, dedup_key FROM r UNION ALL SELECT 'o' || subject_id, 'https://new/' || subject_id FROM r)"


@query(CANDIDATES_SQL + " SELECT candidate, min(subject_id) AS listed_as FROM k JOIN r USING (dedup_key) GROUP BY candidate")
def duplicate_probe(spark, sf_dir):
    return merge.duplicate_probe(_candidates(spark, sf_dir), W.entries(spark, sf_dir)).select("candidate", "listed_as")


@query(CANDIDATES_SQL + " SELECT candidate FROM k ANTI JOIN r USING (dedup_key)")
def add_without_duplicates(spark, sf_dir):
    return merge.without_duplicates(_candidates(spark, sf_dir), W.entries(spark, sf_dir)).select("candidate")


@query("SELECT DISTINCT user_id % 40 AS generation FROM events WHERE event_type = 'error' AND user_id % 40 NOT IN (SELECT n_nationkey FROM nation)")
def ack_gap(spark, sf_dir):
    missing = W.table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("user_id") % 40).alias("generation")).distinct()
    acks = W.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("generation"))
    return merge.not_acknowledged(missing, acks)


@query(f"{W.ENTRIES_SQL} SELECT subject_id, title FROM r WHERE n = 7")
def point_lookup(spark, sf_dir):
    """Record 7 lies under its own id and, wrongly, so does record 8; only the one whose body says the id is found."""
    e = W.entries(spark, sf_dir)
    filed = e.withColumn("filed_as", F.when(F.col("subject_id") == "211111111119", "211111111118").otherwise(F.col("subject_id")))
    return merge.point_lookup(filed, "211111111118").select("subject_id", "title")


# ---- validation
STRUCTURE_SQL = """CASE WHEN strlen(raw_title) NOT BETWEEN 1 AND 200 THEN 'title length' WHEN strlen(snippet) > 500 THEN 'snippet length'
  WHEN regexp_matches(raw_title, '\\p{Cc}') THEN 'title control character' WHEN regexp_matches(snippet, '\\p{Cc}') THEN 'snippet control character'"""
LOCATOR_SQL = "CASE WHEN variant = 1 AND NOT starts_with(url, 'https://') THEN 'not https' END"


@query(f"{W.ENTRIES_SQL} SELECT subject_id, {STRUCTURE_SQL} ELSE {LOCATOR_SQL} END AS reason FROM r")
def validate_structure(spark, sf_dir):
    e = W.entries(spark, sf_dir, clean=False)
    row = F.struct(*(c for c in e.columns if c not in ("subject_id", "version")))
    return e.select("subject_id", V.record_reason(F.col("version"), V.well_formed_subject("subject_id"), F.lit(False), row).alias("reason"))


@query("SELECT event_id, NOT (strlen(w) BETWEEN 1 AND 16 AND regexp_full_match(w, '[A-Za-z0-9_-]+')) AS bad FROM (SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-x_9' WHEN 2 THEN ' x' ELSE '0123456789abcdef' END AS w FROM events)")
def validate_vocab(spark, sf_dir):
    e = W.table(spark, sf_dir, "events")
    tail = F.element_at(F.array(*(F.lit(x) for x in ("", "-x_9", " x", "0123456789abcdef"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", V.bad_vocabulary(F.concat("event_type", tail)).alias("bad"))


@query("SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'not https' WHEN strlen(url) > 512 THEN 'url length' END AS reason FROM pages")
def validate_locator(spark, sf_dir):
    p, none = W.table(spark, sf_dir, "pages"), F.lit(None).cast("string")
    at = F.struct(F.lit("External").alias("variant"), none.alias("contract_id"), F.col("url").alias("url"), none.alias("app"), none.alias("resource"), none.alias("path"))
    return p.select("page_id", V.locator_reason(at).alias("reason"))


@query("SELECT event_id, strlen('k') + strlen(event_type) + strlen('é') + strlen(CAST(event_id AS VARCHAR)) AS ext_bytes FROM events")
def ext_budget(spark, sf_dir):
    ext = F.create_map(F.lit("k"), F.col("event_type"), F.lit("é"), F.col("event_id").cast("string"))
    return W.table(spark, sf_dir, "events").select("event_id", V.ext_bytes(ext).cast("long").alias("ext_bytes"))


KINDS = ("App", "SITE", "external", "room", "Feed", "nonsense")


@query(f"SELECT event_id, CASE WHEN k = 'app' THEN 'App' WHEN k = 'site' THEN 'Site' END AS kind, CASE WHEN k IN ('app', 'site') THEN NULL WHEN k = 'external' THEN 'retired' WHEN k IN ('room', 'feed') THEN 'reserved' ELSE 'unknown' END AS error FROM (SELECT event_id, lower({list(KINDS)}[event_id % 6 + 1]) AS k FROM events)")
def parse_kind(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 6 + 1).cast("int"))
    return W.table(spark, sf_dir, "events").select("event_id", C.parse_kind(kind).alias("k")).select("event_id", "k.*")


@query(f"""{W.ENTRIES_SQL} SELECT subject_id, ['Contract', NULL, 'AppResource'][variant + 1] AS variant, CASE variant WHEN 0 THEN contract_id END AS contract_id,
  CASE variant WHEN 2 THEN source END AS app, CASE variant WHEN 2 THEN subject_id END AS resource, CASE WHEN variant <> 1 THEN path END AS path,
  CASE WHEN variant = 1 THEN 'web refused' END AS error FROM r""")
def parse_locator(spark, sf_dir):
    got = W.entries(spark, sf_dir).select("subject_id", C.parse_locator(C.locator_uri()).alias("p"))
    return got.select("subject_id", *(F.col(f"p.locator.{c}").alias(c) for c in ("variant", "contract_id", "app", "resource", "path")), F.col("p.error").alias("error"))


@query("SELECT doc_id, len(list_filter(t, lambda x: x <> '')) AS n, list_filter(t, lambda x: x <> '')[1] AS first FROM (SELECT doc_id, list_transform(string_split(' ' || lang || ' ,, ' || source || ',' || CAST(doc_id AS VARCHAR) || ' ', ','), lambda x: trim(x)) AS t FROM documents)")
def split_tags(spark, sf_dir):
    text = F.concat(F.lit(" "), "lang", F.lit(" ,, "), "source", F.lit(","), F.col("doc_id").cast("string"), F.lit(" "))
    return W.table(spark, sf_dir, "documents").select("doc_id", C.split_tags(text).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first"))


HOSTILE = ("/ok", "/../x", "//x", "/%2e%2e/x", "/a%00", "/%c0%ae", "/c:/x", "/%252e%252e%252f", "?q=%zz", "#a/./b")


HOSTILE_SQL = ", ".join(f"'{p}'" for p in HOSTILE)
#: What is wrong with the paths above, in their order.
HOSTILE_REASONS = (None, "dot segment", "absolute escape", "dot segment", "control character", "invalid utf-8", "absolute escape", "dot segment", None, "dot segment")
HOSTILE_REASONS_SQL = ", ".join("NULL" if r is None else f"'{r}'" for r in HOSTILE_REASONS)


@query(f"SELECT event_id, [{HOSTILE_SQL}][event_id % 10 + 1] AS path, [{HOSTILE_REASONS_SQL}][event_id % 10 + 1] AS reason FROM events")
def path_guard_report(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, HOSTILE)), (F.col("event_id") % len(HOSTILE) + 1).cast("int"))
    return W.table(spark, sf_dir, "events").select("event_id", path.alias("path")).withColumn("reason", V.path_reason("path"))


@query(f"{W.ENTRIES_SQL} SELECT subject_id, n % 5 = 0 AS ok FROM r")
def subject_id_wellformed(spark, sf_dir):
    """Ids as they are, with a letter that base58 hasn't, cut short, too long, and empty."""
    n, s = F.pmod(W.number("subject_id"), F.lit(5)), F.col("subject_id")
    text = F.when(n == 0, s).when(n == 1, F.concat(F.lit("0"), F.substring(s, 2, 11))).when(n == 2, F.substring(s, 1, 8)).when(n == 3, F.concat(s, s, s)).otherwise("")
    return W.entries(spark, sf_dir).select("subject_id", V.well_formed_subject(text).alias("ok"))


# ---- edits
@query(f"{W.ENTRIES_SQL} SELECT subject_id, CASE WHEN n % 4 <> 3 THEN 2 END AS version, CASE n % 4 WHEN 0 THEN 'new ' || subject_id WHEN 3 THEN NULL ELSE title END AS title, CASE n % 4 WHEN 1 THEN 2 WHEN 3 THEN NULL ELSE 2 END AS n_tags, CASE n % 4 WHEN 3 THEN 'version' WHEN 2 THEN 'nothing to change' END AS reason FROM r")
def next_entry(spark, sf_dir):
    e = W.entries(spark, sf_dir)
    n = F.pmod(F.col("locator.variant").isNull().cast("int") + F.translate(F.substring("subject_id", 2, 11), "123456789A", "0123456789").cast("long"), F.lit(4))
    none = F.lit(None)
    edits = e.select(
        "subject_id", F.when(n == 3, 5).otherwise(1).cast(U64).alias("cur_version"), F.when(n == 0, F.concat(F.lit("new "), "subject_id")).alias("title"), none.cast("string").alias("snippet"),
        F.when(n == 1, " a ,b,").alias("tags"), F.when(n == 3, True).alias("featured"), none.cast("struct<landing:string,adult_sections:boolean,volatility:string,classifier:int>").alias("class_edit"),
        none.cast("array<string>").alias("pairs"), F.lit(False).alias("ext_clear"), none.cast("string").alias("status"),
    )
    made = dml.next_entries(e, edits, W.NOW)
    taken = F.coalesce(F.col("reason") != "version", F.lit(True))
    return made.select("subject_id", F.when(taken, F.col("version").cast("long")).alias("version"), F.when(taken, F.col("title")).alias("title"), F.when(taken, F.size("tags").cast("long")).alias("n_tags"), "reason")


@query(f"{W.ENTRIES_SQL} SELECT subject_id, CASE WHEN judged THEN CASE WHEN toxic THEN 'adult' ELSE 'general' END END AS landing, CASE WHEN judged THEN 'live' END AS volatility, CASE WHEN judged THEN {W.NOW + 1} END AS classified_at, CASE WHEN NOT judged THEN 'landing required' END AS error FROM r")
def next_class(spark, sf_dir):
    edit = F.struct(F.lit(None).cast("string").alias("landing"), F.lit(None).cast("boolean").alias("adult_sections"), F.lit("live").alias("volatility"), F.lit(None).cast("int").alias("classifier"))
    got = W.entries(spark, sf_dir).select("subject_id", C.next_class(F.col("class"), edit, W.NOW + 1).alias("x"))
    return got.select("subject_id", F.col("x.class.landing").alias("landing"), F.col("x.class.volatility").alias("volatility"), F.col("x.class.classified_at").cast("long").alias("classified_at"), F.col("x.error").alias("error"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type || ',a=b=' WHEN 2 THEN event_type || ',' WHEN 3 THEN 'x' END AS ext,
  CASE event_id % 6 WHEN 4 THEN 'key given twice' WHEN 5 THEN 'not key=value' END AS error FROM events""")
def next_ext(spark, sf_dir):
    """k stays, is merged with z, whose value may hold an equals sign or nothing, or is cleared."""
    n = F.col("event_id") % 6
    pairs = F.when(n == 1, F.array(F.lit("z=a=b="))).when(n == 2, F.array(F.lit("z="))).when(n == 3, F.array(F.lit("q=x"))).when(n == 4, F.array(F.lit("q=1"), F.lit("q=2"))).when(n == 5, F.array(F.lit("q")))
    got = W.table(spark, sf_dir, "events").select("event_id", C.next_ext(F.create_map(F.lit("k"), F.col("event_type")), pairs, n == 3).alias("x"))
    text = F.array_join(F.transform(C.sorted_ext(F.col("x.ext")), lambda p: p["value"]), ",")
    return got.select("event_id", text.alias("ext"), F.col("x.error").alias("error"))


@query(f"""{W.ENTRIES_SQL} SELECT subject_id, CASE n % 8 WHEN 0 THEN 'reserved' WHEN 1 THEN 'web refused' WHEN 2 THEN 'title length' WHEN 3 THEN 'tags' WHEN 4 THEN 'key given twice' WHEN 5 THEN 'duplicate' WHEN 6 THEN CASE WHEN n % 16 = 6 THEN NULL ELSE 'duplicate' END END AS reason FROM r""")
def add_entries(spark, sf_dir):
    """Requests that are refused for their kind, locator, title, tags or pairs, or as listed already or earlier in the batch; the rest pass."""
    e, n = W.entries(spark, sf_dir), F.pmod(W.number("subject_id"), F.lit(8))
    number = W.number("subject_id")
    fresh = F.concat(F.lit("app:src1/"), F.rpad(F.translate(number.cast("string"), "0", "A"), 14, "z"))
    twin = F.concat(F.lit("app:src2/"), F.rpad(F.translate(F.floor(number / 16).cast("string"), "0", "A"), 14, "y"), F.when(number % 16 == 6, "/a").otherwise("/b"))
    requests = e.select(
        F.concat(F.lit("3"), F.substring("subject_id", 2, 11)).alias("subject_id"), F.when(n == 0, "room").otherwise("Site").alias("kind"), F.when(n == 2, F.repeat(F.lit("é"), 101)).otherwise("A title").alias("title"),
        F.lit("").alias("snippet"), F.when(n == 3, F.repeat(F.lit("t,x"), 20)).otherwise("a, b").alias("tags"),
        F.when(n == 1, "https://x").when(n == 5, F.concat(F.lit("app:listed/"), F.rpad(F.translate(number.cast("string"), "0", "A"), 14, "z"), F.lit("/other"))).when(n == 6, twin).otherwise(fresh).alias("locator"), F.lit(False).alias("featured"),
        F.lit(None).cast(CLASS).alias("class"), F.when(n == 4, F.array(F.lit("a=1"), F.lit("a=2"))).alias("pairs"),
    )
    at = F.struct(F.lit("AppResource").alias("variant"), F.lit(None).cast("string").alias("contract_id"), F.lit(None).cast("string").alias("url"), F.lit("listed").alias("app"), F.rpad(F.translate(number.cast("string"), "0", "A"), 14, "z").alias("resource"), F.lit("").alias("path"))
    listed = e.where(n == 5).withColumn("locator", at)
    made = dml.add(listed, requests, W.NOW)
    return made.select(F.concat(F.lit("2"), F.substring("subject_id", 2, 11)).alias("subject_id"), "reason")


@query(f"{W.RECORDS_SQL} SELECT user_id AS subject_id, version + 1 AS version, true AS is_tomb FROM w")
def tombstone(spark, sf_dir):
    made = dml.tombstones(merge.latest(W.records(spark, sf_dir).select(*ROW), "user_id").select(F.col("user_id").alias("subject_id"), "version"))
    return made.select("subject_id", F.col("version").cast("long").alias("version"), "is_tomb")


# ---- sources
@query("SELECT conv_id * 100 + turn AS seq, role AS author_id, text AS content FROM conversations WHERE conv_id % 10 = 3 AND conv_id * 100 + turn > 500 AND role <> 'system' ORDER BY seq LIMIT 20")
def messages_since(spark, sf_dir):
    return M.messages_since(W.messages(spark, sf_dir), 3, 500, 20)


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'schema version' WHEN event_id % 6 = 1 THEN 'no state for the room' WHEN event_id % 6 = 2 THEN 'generation not attested'
  WHEN event_id % 6 = 3 THEN 'never reconciled' WHEN age < 0 THEN 'reconciled in the future' WHEN age > {MAX_RECONCILE_AGE} THEN 'stale' END AS reason
  FROM (SELECT event_id, {W.NOW} - CAST(floor(epoch(ts)) AS BIGINT) AS age FROM events)""")
def mirror_gate(spark, sf_dir):
    n = F.col("event_id") % 6
    last = F.when(n == 3, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+05:00"))
    return W.table(spark, sf_dir, "events").select("event_id", M.gate_reason(F.when(n == 0, 2).otherwise(1), n != 1, F.when(n == 2, 0).otherwise(1), last, W.NOW).alias("reason"))


PAGES_SQL = r"""
WITH h AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article, regexp_extract(html, '(?s)<body>(.*)', 1) AS body FROM pages),
u AS (SELECT page_id, unnest([1, 2]) AS part, unnest([article, body]) AS x FROM h),
v AS (SELECT page_id, part, regexp_replace(regexp_replace(regexp_replace(x, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g'), '</?(p|div|section|article|main|ul|ol|li|h[1-6]|table|tr|header|footer|nav|aside|pre|blockquote|br)( [^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM u),
w AS (SELECT page_id, part, replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&') AS x FROM v),
t AS (SELECT page_id, part, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\f]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS x FROM w),
c AS (SELECT h.page_id, url, len(regexp_extract_all(html, '<a [^>]*href="[^"]+"')) AS n_links, a.x AS article, b.x AS body FROM h JOIN t AS a ON a.page_id = h.page_id AND a.part = 1 JOIN t AS b ON b.page_id = h.page_id AND b.part = 2)
"""


@query(PAGES_SQL + "SELECT page_id, CASE WHEN length(article) > 80 THEN article ELSE body END AS content FROM c")
def content_region(spark, sf_dir):
    return W.table(spark, sf_dir, "pages").select("page_id", H.content_region("html").alias("content"))


@query(PAGES_SQL + "SELECT page_id, url, length(article) AS size, n_links FROM c WHERE length(article) >= 200")
def describable_pages(spark, sf_dir):
    pages = W.table(spark, sf_dir, "pages").select("page_id", "url", H.content_region("html", strict=True).alias("content"), H.links("html").alias("links"))
    return pages.withColumn("size", H.content_size(F.col("content"))).where(H.is_describable(F.col("size"))).select("page_id", "url", "size", F.size("links").alias("n_links"))


@query("SELECT page_id FROM pages WHERE page_id % 5 IN (0, 1)")
def served_pages(spark, sf_dir):
    """Pages with statuses 200, 299, 300, 500 and none: only 2xx may be read."""
    status = F.element_at(F.array(*(F.lit(x).cast("int") for x in (200, 299, 300, 500, None))), (F.col("page_id") % 5 + 1).cast("int"))
    return W.table(spark, sf_dir, "pages").where(P.served(status)).select("page_id")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS nth FROM pages")
def picked_frames(spark, sf_dir):
    """A sandboxed frame before a longer one, else the longest, else the first."""
    size = lambda nth: F.when(F.col("page_id") % 3 == 1, nth).otherwise(F.lit(5))
    url = lambda nth: F.when((F.col("page_id") % 3 == 0) & (nth == 1), F.concat("url", F.lit("?__sandbox=1"))).otherwise(F.col("url"))
    frames = W.table(spark, sf_dir, "pages").select("page_id", F.explode(F.transform(F.array(*map(F.lit, range(3))), lambda n: F.struct(n.alias("nth"), url(n).alias("url"), size(n).alias("size")))).alias("f"))
    return P.picked_frames(frames.select("page_id", "f.*")).select("page_id", "nth")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '#a/1,#a/2,#a/3' WHEN 1 THEN '#a/1,#a/2' WHEN 2 THEN '#a/1' ELSE '#a/1,#a/2' END AS pages, page_id % 4 = 3 AS partial FROM pages""")
def walked_pages(spark, sf_dir):
    """Walks that pass their entry once, meet a page again, stay on the entry, and break off."""
    walks = (("#a/1", "#a/1", "#a/2", "#a/3", "#a/3", "#a/4"), ("#a/1", "#a/2", "#a/2", "#a/9"), ("#a/1", "#a/1", "#a/1", "#a/5"), ("#a/1", "#a/2", None, "#a/3"))
    hashes = F.element_at(F.array(*(F.array(*map(F.lit, w)) for w in walks)), (F.col("page_id") % 4 + 1).cast("int"))
    steps = W.table(spark, sf_dir, "pages").select("page_id", F.posexplode(hashes).alias("step", "hash"))
    return P.walked_pages(steps, "page_id").select("page_id", F.array_join("pages", ",").alias("pages"), "partial")


@query("SELECT n_nationkey AS app_id, CASE WHEN n_nationkey % 4 = 0 THEN 'skip' WHEN n_nationkey % 4 = 1 THEN 'put' WHEN n_nationkey % 4 = 2 THEN 'update' ELSE 'refuse' END AS decision FROM nation")
def publish_decision(spark, sf_dir):
    n = W.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.lit(5).alias("version"), F.col("n_name").alias("state"))
    k = F.col("app_id") % 4
    there = n.select("app_id", F.when(k == 1, "absent").otherwise("present").alias("status"), F.when(k == 2, 4).otherwise(5).alias("version"), F.when(k == 0, F.col("state")).otherwise("other").alias("state"))
    return pointers.publish_decision(n, there)


@query("SELECT n_nationkey AS app_id, n_name AS state FROM nation WHERE n_regionkey = 2")
def vanished_records(spark, sf_dir):
    n = W.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("state"), "n_regionkey")
    return pointers.vanished(n, n.where("n_regionkey <> 2")).drop("n_regionkey")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 7000 WHEN 2 THEN 9000 ELSE 26000 END AS ms, page_id % 2 = 0 AS settled FROM pages")
def settled_pages(spark, sf_dir):
    """Polls of pages that stand still, are thin and wait, grow for a while, and are empty."""
    kind, at = F.col("page_id") % 4, F.array(*map(F.lit, (0, 2000, 4000, 6500, 7000, 7500, 8000, 8500, 9000, 26_000)))
    polls = W.table(spark, sf_dir, "pages").select("page_id", F.explode(at).alias("ms"))
    length = F.when(kind == 3, 0).when(kind == 2, F.least(F.col("ms"), F.lit(8000))).otherwise(100)
    polls = polls.select("page_id", "ms", length.alias("length"), F.lit(0).alias("anchors"), F.when(kind == 1, 10).otherwise(300).alias("size"), (kind == 1).alias("waiting"))
    return P.settled(polls)


NATION_SQL = "(SELECT n_nationkey AS app_id, n_nationkey % 5 AS k FROM nation)"


@query("SELECT n_nationkey AS app_id, n_name AS state, CASE WHEN n_regionkey <> 2 THEN lower(n_name) END AS old_state FROM nation")
def paired_records(spark, sf_dir):
    """Records with what base has under the same id, in whatever order base stands; new ones have nothing."""
    n = W.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("state"), "n_regionkey")
    base = n.where("n_regionkey <> 2").orderBy(F.desc("app_id")).select("app_id", F.lower("state").alias("state"))
    return pointers.paired(base, n.drop("n_regionkey"))


@query(f"SELECT app_id, CASE k WHEN 1 THEN 'hash' WHEN 2 THEN 'signature' WHEN 3 THEN 'version not raised' END AS reason FROM {NATION_SQL}")
def freshness(spark, sf_dir):
    """Records that are sound, of another file, badly signed, changed at the same version, and changed at a higher one."""
    k = F.col("app_id") % 5
    n = W.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("state"))
    base = n.select("app_id", F.lit(2).alias("version"), F.when(k >= 3, "old").otherwise(F.col("state")).alias("state"))
    head = n.select("app_id", F.when(k == 4, 3).otherwise(2).alias("version"), "state", F.lit("h").alias("code_hash"), F.when(k == 1, "other").otherwise("h").alias("actual_hash"))
    return pointers.paired(base, head).select("app_id", pointers.freshness_reason(F.col("app_id") % 5 != 2).alias("reason"))


@query(f"SELECT app_id, CASE WHEN k = 0 THEN 'not written' WHEN k < 3 THEN 'verified' ELSE 'unverified' END AS outcome FROM {NATION_SQL}")
def read_back(spark, sf_dir):
    k = F.col("app_id") % 5
    n = W.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app_id"), F.lit(4).alias("version"), F.col("n_name").alias("state"), F.lit("h").alias("code_hash"))
    there = n.where(k != 0).select("app_id", F.when(k == 3, 3).otherwise(4).alias("version"), F.when(k == 4, "x").otherwise(F.col("state")).alias("state"), "code_hash")
    return pointers.read_back(n, there)


@query("SELECT r_regionkey AS region, r_regionkey NOT IN (1, 4) AS green FROM region")
def rollup_green(spark, sf_dir):
    """Runs by region: one bad run spoils region 1, and none at all (region 4) isn't green."""
    runs = W.table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_regionkey").alias("region"), ((F.col("n_regionkey") != 1) | (F.col("n_nationkey") != 1)).alias("ok"))
    return pointers.green_of(W.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region")), runs, "region")


# ---- streaming
@query(f"{W.RECORDS_SQL} SELECT {ROW_SQL} FROM w")
def stream_lww(spark, sf_dir):
    """The winners of a stream over the events file; equal to the batch's."""
    folder = f"{places.shared_folder(spark)}/lww_{uuid.uuid4().hex}"
    places.remove(spark, folder, at_exit=True)
    schema = W.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = stream.select("user_id", (1 + F.col("event_id") % 7).alias("version"), (F.col("event_type") == "error").alias("is_tomb"), F.sha2(F.col("event_id").cast("string"), 256).alias("sig"))
    run = into_snapshots(events, f"{folder}/winners", f"{folder}/stream", "user_id")
    run.awaitTermination()
    return last_snapshot(run, spark, f"{folder}/winners", events.schema)
