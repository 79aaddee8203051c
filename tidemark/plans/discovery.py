"""Registered queries of the discovery operators (indexes, ranking signals), with the DuckDB SQL they must agree with."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import collections as L
from tidemark.operators import diversity as D
from tidemark.operators import feedback as B
from tidemark.operators import keyword_index as K
from tidemark.operators import merge
from tidemark.operators import trust as T
from tidemark.operators import vector_index as V
from tidemark.operators.places import durable, parts_for, remove, shared_folder
from tidemark.plans import views as W
from tidemark.plans.registry import query


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the cluster's shared store, deleted as the driver ends."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)
    return folder


# ---- keyword index
def terms_sql(table: str, key: str) -> str:
    return f"SELECT {key}, list_value AS term, CAST(nth AS INT) - 1 AS place FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS l FROM {table}) s, LATERAL (SELECT unnest(l) AS list_value, generate_subscripts(l, 1) AS nth)"


def texts_index(spark: SparkSession, sf_dir: str) -> K.Index:
    return K.build(W.table(spark, sf_dir, "documents"), scratch(spark, "texts"))


@query(f"""
WITH t AS ({terms_sql("documents", "doc_id")}), a AS ({terms_sql("benchmark", "item_id")}),
n AS (SELECT doc_id AS doc, count(*) AS len FROM t GROUP BY doc_id), m AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT term, doc_id AS doc, count(*) AS tf FROM t GROUP BY term, doc_id), d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT item_id AS query, term, count(*) AS times FROM a GROUP BY item_id, term),
s AS (
  SELECT query, doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
  FROM q JOIN f USING (term) JOIN d USING (term) JOIN n USING (doc), m GROUP BY query, doc
)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rn, doc, round(score, 6) AS score FROM s QUALIFY rn <= 10
""")
def keyword_search(spark, sf_dir):
    """The ten documents that each text of benchmark finds."""
    found = K.search(texts_index(spark, sf_dir), W.table(spark, sf_dir, "benchmark"), 10, "item_id")
    return found.withColumn("score", F.round("score", 6))


@query(f"""
WITH t AS ({terms_sql("documents", "doc_id")}), a AS ({terms_sql("benchmark", "item_id")}), q AS (SELECT item_id AS query, term, place - 2 AS place FROM a WHERE place BETWEEN 2 AND 6),
z AS (SELECT query, count(*) AS n FROM q GROUP BY query)
SELECT query, doc_id AS doc, t.place - q.place AS place FROM q JOIN t USING (term) JOIN z USING (query) GROUP BY query, doc_id, t.place - q.place, n HAVING count(*) = n
""")
def phrase_search(spark, sf_dir):
    """Every place of the third to seventh term of each text of benchmark, in that order."""
    terms = K.terms_of("text")
    asked = W.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(terms, 3, 5), " ").alias("text"))
    return K.phrases(texts_index(spark, sf_dir), asked)


def with_texts(spark: SparkSession, sf_dir: str, versions: DataFrame) -> DataFrame:
    """Versions of documents, each with the text of one of documents."""
    texts = W.table(spark, sf_dir, "documents").select("doc_id", "text")
    return versions.join(texts, F.col("subject_id") * 7 + F.col("version") == F.col("doc_id"), "left").drop("doc_id")


@query(f"""{W.RECORDS_SQL},
x AS (SELECT user_id AS doc, text FROM w LEFT JOIN documents ON doc_id = user_id * 7 + version WHERE NOT is_tomb), t AS ({terms_sql("x", "doc")})
SELECT term, count(DISTINCT doc) AS df, count(*) AS cf, CAST(sum(doc) AS BIGINT) AS docs, CAST(sum(place) AS BIGINT) AS places FROM t GROUP BY term
""")
def index_deltas(spark, sf_dir):
    """The terms of an index that took four generations of events one after another, as deltas of what each changes.

    A version names its text, so texts are looked up once, for what the generations changed only.
    """
    state, changes = None, []
    versions = W.records(spark, sf_dir).withColumnRenamed("user_id", "subject_id")
    for generation in range(4):
        rows = versions.where(F.col("generation") == generation)
        before, state = state, durable(merge.latest(rows if state is None else state.unionByName(rows)))
        changes.append(state if before is None else merge.delta_records(state, merge.summarize_records(before)))
    changed = durable(with_texts(spark, sf_dir, reduce(DataFrame.unionByName, changes)))
    index = K.create(spark, scratch(spark, "deltas"))
    for generation in range(4):  # what a generation changed are its own versions
        index = K.apply_delta(index, changed.where(F.col("generation") == generation), "subject_id")
    return index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.col("doc") * F.col("tf")).alias("docs"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, b: a + b)).alias("places"))


# ---- vector index
NEAREST_SQL = """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.id AS query, v.id AS id, round(list_sum(list_transform(list_zip(q.v, v.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS distance FROM v AS q JOIN v ON q.id % 50 = 0 AND q.id <> v.id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rn, id, distance FROM d QUALIFY rn <= 10
"""


def _near_vectors(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    rows = V.usable(W.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    quantiser = V.fit(rows)
    place = scratch(spark, "vectors")
    V.encode(rows, quantiser).write.parquet(place)
    return V.nearest(spark.read.parquet(place), rows.where("id % 50 = 0"), quantiser, **how)


@query()
def vector_search(spark, sf_dir):
    """The ten nearest of embeddings for each id divisible by 50, by probing as many cells as the fit found necessary; recall is measured in the tests."""
    return _near_vectors(spark, sf_dir, k=10)


@query(NEAREST_SQL)
def vector_exact(spark, sf_dir):
    """The same by probing all cells and measuring all rows."""
    return _near_vectors(spark, sf_dir, k=10, probes=1 << 20, rerank=None)


# ---- feedback and trust
def chain(first: str, step, steps: int) -> str:
    """CTEs s0, s1, ... each made of the one before; every one is computed once."""
    return ", ".join([f"s0 AS MATERIALIZED ({first})", *(f"s{i} AS MATERIALIZED ({step(f's{i - 1}')})" for i in range(1, steps + 1))])


STRENGTH_STEPS = 10
MEETINGS_SQL = """
WITH price AS (SELECT l_partkey AS part, l_suppkey AS supplier, round(avg(l_extendedprice / l_quantity), 4) AS price FROM lineitem GROUP BY ALL),
beside AS (SELECT supplier, price, lead(supplier) OVER part AS other, lead(price) OVER part AS other_price FROM price WINDOW part AS (PARTITION BY part ORDER BY supplier)),
met AS (SELECT CASE WHEN price < other_price THEN supplier ELSE other END AS winner, CASE WHEN price < other_price THEN other ELSE supplier END AS loser FROM beside WHERE price <> other_price),
both_ AS MATERIALIZED (SELECT item, other, count(*) AS n, sum(won) AS won FROM (SELECT winner AS item, loser AS other, 1 AS won FROM met UNION ALL SELECT loser, winner, 0 FROM met) GROUP BY ALL),
items AS MATERIALIZED (SELECT item, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(n) AS BIGINT) AS met FROM both_ GROUP BY item)
"""


@query(f"""{MEETINGS_SQL}, {chain("SELECT item, wins, met, CAST(1 AS DOUBLE) AS strength FROM items", lambda s: f'''
SELECT a.item, a.wins, a.met, (a.wins + 1) / (load + 2 / (a.strength + 1)) AS strength FROM {s} AS a
JOIN (SELECT b.item, sum(n / (x.strength + y.strength)) AS load FROM both_ AS b JOIN {s} AS x ON b.item = x.item JOIN {s} AS y ON b.other = y.item GROUP BY b.item) AS l ON a.item = l.item''', STRENGTH_STEPS)}
SELECT item AS supplier, wins, met, round(strength, 4) AS strength FROM s{STRENGTH_STEPS}""")
def supplier_strengths(spark, sf_dir):
    """Suppliers by how they do against the next supplier of the same part: the lower mean price of a piece wins."""
    from pyspark.sql import Window

    piece = F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4)
    lines = W.table(spark, sf_dir, "lineitem")
    price = lines.groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(piece.alias("price"))
    part = Window.partitionBy("part").orderBy("supplier")
    met = price.withColumns({"other": F.lead("supplier").over(part), "other_price": F.lead("price").over(part)}).where(F.col("price") != F.col("other_price"))
    first = F.col("price") < F.col("other_price")
    met = met.select(F.when(first, F.col("supplier")).otherwise(F.col("other")).alias("winner"), F.when(first, F.col("other")).otherwise(F.col("supplier")).alias("loser"))
    with parts_for(spark, lines.count()):
        found = B.strengths(met.groupBy("winner", "loser").agg(F.count("*").alias("n")), steps=STRENGTH_STEPS, tolerance=0.0)
    return found.select(F.col("item").alias("supplier"), "wins", "met", F.round("strength", 4).alias("strength"))


TRUST_STEPS = 12


@query(f"""
WITH l AS (SELECT 'c' || o_custkey AS c, 's' || l_suppkey AS s, l_returnflag AS flag, l_linestatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e0 AS (SELECT c AS source, s AS target, count(*) AS w FROM l WHERE flag <> 'R' GROUP BY ALL UNION ALL SELECT s, c, count(*) FROM l WHERE status = 'F' GROUP BY ALL),
o AS (SELECT source, sum(w) AS total FROM e0 GROUP BY source), e AS MATERIALIZED (SELECT e0.source, target, CAST(w AS DOUBLE) / CAST(total AS DOUBLE) AS w FROM e0 JOIN o ON e0.source = o.source),
seed AS (SELECT 'c' || c_custkey AS node, 1.0 / count(*) OVER () AS seed FROM customer WHERE c_acctbal > 9000),
n AS MATERIALIZED (SELECT x.node, CAST(coalesce(seed, 0) AS DOUBLE) AS seed, o.source IS NULL AS idle FROM (SELECT source AS node FROM e UNION SELECT target FROM e UNION SELECT node FROM seed) AS x LEFT JOIN seed ON x.node = seed.node LEFT JOIN o ON x.node = o.source),
{chain("SELECT node, seed AS trust FROM n", lambda s: f'''
SELECT n.node, (0.15 + 0.85 * (SELECT coalesce(sum(trust), 0) FROM {s} JOIN n AS i ON i.node = {s}.node WHERE i.idle)) * seed + 0.85 * coalesce(got, 0) AS trust
FROM n LEFT JOIN (SELECT target, sum(trust * w) AS got FROM e JOIN {s} ON e.source = {s}.node GROUP BY target) AS g ON n.node = g.target''', TRUST_STEPS)}
SELECT node, round(trust, 9) AS trust FROM s{TRUST_STEPS}""")
def supplier_trust(spark, sf_dir):
    """Trust from customers with much on their accounts: customers trust suppliers of lines they kept, suppliers trust customers of finished lines."""
    lines = W.table(spark, sf_dir, "lineitem")
    node = lambda key, kind: F.shiftleft(F.col(key).cast("long"), 1).bitwiseOR(F.lit(kind))  # noqa: E731  numbers are joined faster than names
    named = lambda n: F.concat(F.when(n.bitwiseAND(1) == 0, "c").otherwise("s"), F.shiftright(n, 1))
    c, s = node("o_custkey", 0), node("l_suppkey", 1)
    edge = lambda when, source, target: F.struct(F.when(F.expr(when), source).alias("source"), target.alias("target"), F.lit(1).alias("weight"))
    sold = lines.join(W.table(spark, sf_dir, "orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = sold.select(F.inline(F.array(edge("l_returnflag <> 'R'", c, s), edge("l_linestatus = 'F'", s, c)))).where("source is not null")
    seeds = W.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(node("c_custkey", 0).alias("node"), F.lit(1).alias("share"))
    with parts_for(spark, lines.count()):
        found = T.propagate(edges, seeds, steps=TRUST_STEPS, tolerance=0.0)
    return found.select(named(F.col("node")).alias("node"), F.round("trust", 9).alias("trust"))


GRADES, GRADE_STEPS = 3, 8
_each = lambda of: ", ".join(of(j) for j in range(GRADES))
_plus = lambda of: " + ".join(of(j) for j in range(GRADES))


def _em_sql() -> str:
    """Each step: confusion by the beliefs before, then beliefs by the confusion and the mean of the beliefs before."""
    parts = [f"b0 AS MATERIALIZED (SELECT item, {_each(lambda j: f'(sum(CASE WHEN grade = {j} THEN n ELSE 0 END) + CAST(1 AS DOUBLE) / {GRADES}) / (sum(n) + 1) AS p{j}')} FROM c GROUP BY item)"]
    for i in range(1, GRADE_STEPS + 1):
        b = f"b{i - 1}"
        parts += [
            f"w{i} AS MATERIALIZED (SELECT r.rater, r.grade, {_each(lambda j: f'coalesce(sum(n * p{j}), 0) + 1 AS w{j}')} FROM r LEFT JOIN (SELECT * FROM c JOIN {b} USING (item)) AS x ON r.rater = x.rater AND r.grade = x.grade GROUP BY r.rater, r.grade)",
            f"k{i} AS MATERIALIZED (SELECT rater, grade, {_each(lambda j: f'w{j} / sum(w{j}) OVER (PARTITION BY rater) AS q{j}')} FROM w{i})",
            f"l{i} AS MATERIALIZED (SELECT item, {_each(lambda j: f'sum(n * ln(q{j})) + ln((SELECT avg(p{j}) FROM {b})) AS l{j}')} FROM c JOIN k{i} USING (rater, grade) GROUP BY item)",
            f"m{i} AS MATERIALIZED (SELECT *, greatest({_each(lambda j: f'l{j}')}) AS top FROM l{i})",
            f"b{i} AS MATERIALIZED (SELECT item, {_each(lambda j: f'exp(l{j} - top) / ({_plus(lambda h: f"exp(l{h} - top)")}) AS p{j}')} FROM m{i})",
        ]
    return ", ".join(parts)


@query(f"""
WITH v AS (SELECT user_id AS rater, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS item, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS grade FROM events),
c AS MATERIALIZED (SELECT rater, item, grade, CAST(count(*) AS DOUBLE) AS n FROM v WHERE rater IS NOT NULL GROUP BY ALL),
r AS (SELECT rater, grade FROM (SELECT DISTINCT rater FROM c), (SELECT unnest(range({GRADES})) AS grade)), {_em_sql()}
SELECT item, {_each(lambda j: f'round(p{j}, 6) AS p{j}')}, (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.item = b{GRADE_STEPS}.item) AS ratings FROM b{GRADE_STEPS}""")
def hour_grades(spark, sf_dir):
    """How good each hour was by its events: users rate hours 0 with an error, 1 with a click, 2 otherwise, and differ in what these mean."""
    events = W.table(spark, sf_dir, "events")
    grade = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    rated = events.select(F.col("user_id").alias("rater"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long").alias("item"), grade.alias("grade"))
    items, _, _ = B.graded(rated, GRADES, steps=GRADE_STEPS, tolerance=-1.0)
    return items.select("item", *(F.round(F.col("p")[j], 6).alias(f"p{j}") for j in range(GRADES)), "ratings")


# ---- diversity
PICKS = 10


def _picks_sql() -> str:
    parts = ["s0 AS MATERIALIZED (SELECT *, CAST(0 AS DOUBLE) AS worst FROM i)"]
    for n in range(1, PICKS + 1):
        s = f"s{n - 1}"
        parts.append(f"p{n} AS MATERIALIZED (SELECT DISTINCT ON (lang) lang, {n} AS rn, id, round(0.7 * relevance - 0.3 * worst, 9) AS score, v FROM {s} ORDER BY lang, round(0.7 * relevance - 0.3 * worst, 9) DESC, id)")
        parts.append(f"s{n} AS MATERIALIZED (SELECT s.lang, s.id, relevance, s.v, greatest(worst, list_cosine_similarity(s.v, p.v)) AS worst FROM {s} AS s JOIN p{n} AS p ON s.lang = p.lang AND s.id <> p.id)")
    return ", ".join(parts)


@query(f"""
WITH i AS (SELECT lang, doc_id AS id, 1 - CAST(1 AS DOUBLE) / (1 + n_chars / 1000.0) AS relevance, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang IS NOT NULL), {_picks_sql()}
{" UNION ALL ".join(f"SELECT lang, rn, id, round(score, 6) AS score FROM p{n}" for n in range(1, PICKS + 1))}""")
def diverse_documents(spark, sf_dir):
    """Ten documents of each language that are long and unlike each other by their embeddings."""
    vectors = W.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = W.table(spark, sf_dir, "documents").where("lang is not null").select("lang", F.col("doc_id").alias("id"), (1 - 1 / (1 + F.col("n_chars") / 1000)).alias("relevance"))
    return D.diverse(docs.join(vectors, "id"), "lang", PICKS).withColumn("score", F.round("score", 6))


# ---- collections
@query("""
WITH e AS (SELECT user_id AS collection, event_id, event_type, event_id % 3 AS curator, lpad(CAST(CAST(round(value * 100) AS BIGINT) % 9973 AS VARCHAR), 4, '0') || 'V' AS position, props FROM events),
b AS (SELECT *, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY collection, curator ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
a AS (SELECT collection, event_id AS tag, props AS item FROM e WHERE event_type = 'click'),
m AS (SELECT tag, arg_max(position, version) AS position FROM (SELECT event_id AS tag, event_id AS version, position FROM e WHERE event_type = 'click' UNION ALL SELECT before, event_id, position FROM b WHERE event_type = 'view' AND before IS NOT NULL) GROUP BY tag)
SELECT a.collection, row_number() OVER (PARTITION BY a.collection ORDER BY position, CAST(a.tag AS VARCHAR)) AS nth, CAST(a.tag AS VARCHAR) AS tag, item
FROM a JOIN m ON a.tag = m.tag WHERE a.tag NOT IN (SELECT before FROM b WHERE event_type = 'error' AND before IS NOT NULL) AND item IS NOT NULL
""")
def collection_lists(spark, sf_dir):
    """events as edits of three curators: a click adds an element, a view moves the curator's last addition to that collection, an error removes it."""
    from pyspark.sql import Window

    position = F.concat(F.lpad((F.round(F.col("value") * 100).cast("long") % 9973).cast("string"), 4, "0"), F.lit("V"))
    e = W.table(spark, sf_dir, "events").select(F.col("user_id").alias("collection"), "event_id", "event_type", F.col("event_id").alias("version"), (F.col("event_id") % 3).alias("curator"), position.alias("position"), F.col("props").alias("item"))
    own = Window.partitionBy("collection", "curator").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("tag", F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(own))
    later = e.where("tag is not null")
    replicas = [L.merge(L.added(x.where("event_type = 'click'").withColumn("tag", F.col("event_id"))), L.moved(y.where("event_type = 'view'")), L.removed(y.where("event_type = 'error'"))) for x, y in ((e.where(F.col("curator") == c), later.where(F.col("curator") == c)) for c in range(3))]
    return L.listed(L.merge(*replicas))
