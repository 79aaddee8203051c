"""The engine's model over the synthetic tables: deterministic projections, written once for Spark and once for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import APPS, CLASS, U64, VERIFIED

NOW = 1_700_001_000
TEMPLATE = "/#{resource}{path}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: those of its folder, or the one file that it is, which a stream finds in the folder above."""
    at = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return files.parquet(at)
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def subject(n: Column) -> Column:
    """Nine bytes in base58, in the order of the number."""
    return F.concat(F.lit("2"), F.translate(F.lpad(n.cast("string"), 11, "0"), "0123456789", "123456789A"))


def number(subject_id: str) -> Column:
    """The number that a subject was made of."""
    return F.translate(F.substring(subject_id, 2, 11), "123456789A", "0123456789").cast("long")


def entries(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """documents and labels as index entries; clean titles are legal ones."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")
    n = F.col("doc_id")
    sid = subject(n)
    title = F.trim(F.substring(F.regexp_replace("text", r"\p{Cc}+", " "), 1, 60)) if clean else F.substring_index("text", "\n", 1)
    none = F.lit(None).cast("string")
    path = F.element_at(F.array(*(F.lit(p) for p in ("", "/", "#frag", "?q=1", "/a/b"))), (n % 5 + 1).cast("int"))
    scheme = F.when(n % 2 == 0, "https://").otherwise("http://")
    locator = F.struct(
        F.element_at(F.array(F.lit("Contract"), F.lit("External"), F.lit("AppResource")), (n % 3 + 1).cast("int")).alias("variant"),
        F.when(n % 3 == 0, F.rpad(sid, 44, "2")).otherwise(none).alias("contract_id"),
        F.when(n % 3 == 1, F.concat(scheme, F.lit("host/"), n.cast("string"))).otherwise(none).alias("url"),
        F.when(n % 3 == 2, F.col("source")).otherwise(none).alias("app"),
        F.when(n % 3 == 2, sid).otherwise(none).alias("resource"),
        F.when(n % 3 != 1, path).otherwise(none).alias("path"),
    )
    judged = F.struct(F.when(F.col("toxic") == 1, "adult").otherwise("general").alias("landing"), (F.col("toxic") == 1).alias("has_adult_sections"), F.lit("static").alias("volatility"), F.lit(0).alias("classifier"), F.lit(NOW).cast(U64).alias("classified_at")).cast(CLASS)
    return d.join(lab, n == F.col("_id"), "left").select(
        sid.alias("subject_id"), F.lit(1).cast(U64).alias("version"), F.when(n % 3 == 0, "App").otherwise("Site").alias("kind"),
        title.alias("title"), F.substring("text", 1, 500).alias("snippet"), F.array("lang", "source").alias("tags"), locator.alias("locator"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("featured"), (F.lit(1_700_000_000) + n % 97).cast(U64).alias("added_at"),
        F.when(F.col("_id").isNotNull(), judged).alias("class"), F.lit(None).cast(VERIFIED).alias("verified"), F.lit(None).cast("map<string,string>").alias("ext"),
    )


ENTRIES_SQL = """
WITH e AS (
  SELECT d.doc_id AS n, 1 AS version,
    '2' || translate(lpad(CAST(d.doc_id AS VARCHAR), 11, '0'), '0123456789', '123456789A') AS subject_id,
    CASE WHEN d.doc_id % 3 = 0 THEN 'App' ELSE 'Site' END AS kind,
    trim(substr(regexp_replace(text, '\\p{Cc}+', ' ', 'g'), 1, 60)) AS title,
    split_part(text, chr(10), 1) AS raw_title,
    substr(text, 1, 500) AS snippet, lang, source,
    coalesce(quality = 1, false) AS featured, 1700000000 + d.doc_id % 97 AS added_at,
    l.doc_id IS NOT NULL AS judged, coalesce(toxic = 1, false) AS toxic,
    d.doc_id % 3 AS variant,
    rpad('2' || translate(lpad(CAST(d.doc_id AS VARCHAR), 11, '0'), '0123456789', '123456789A'), 44, '2') AS contract_id,
    CASE WHEN d.doc_id % 2 = 0 THEN 'https://' ELSE 'http://' END || 'host/' || CAST(d.doc_id AS VARCHAR) AS url,
    ['', '/', '#frag', '?q=1', '/a/b'][d.doc_id % 5 + 1] AS path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), a AS (SELECT 'src' || CAST(i AS VARCHAR) AS app, rpad('3', 44, '3') AS app_id, 'App ' || CAST(i AS VARCHAR) AS app_name FROM range(10) t(i))
, r AS (
  SELECT e.*, CASE variant WHEN 0 THEN 'contract:' || contract_id || path WHEN 1 THEN url ELSE 'app:' || source || '/' || subject_id || path END AS uri,
    CASE variant WHEN 0 THEN 'contract:' || contract_id || path WHEN 1 THEN url ELSE 'app:' || source || '/' || subject_id END AS dedup_key,
    CASE variant WHEN 0 THEN '/v1/contract/web/' || contract_id || CASE WHEN starts_with(path, '/') THEN '' ELSE '/' END || path WHEN 1 THEN url
      ELSE '/v1/contract/web/' || app_id || '/#' || subject_id || path END AS href,
    CASE WHEN variant = 2 THEN coalesce(app_name, source) END AS host_app
  FROM e LEFT JOIN a ON variant = 2 AND a.app = source
)
"""


def apps(spark: SparkSession) -> DataFrame:
    """Ten registered apps; sources beyond them stay unresolvable."""
    return spark.createDataFrame([(f"src{i}", "3" * 44, f"App {i}", TEMPLATE) for i in range(10)], APPS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as record versions of their users."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "event_id", (1 + F.col("event_id") % 7).alias("version"), (F.col("event_type") == "error").alias("is_tomb"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("sig"), (F.col("event_id") % 4).alias("generation"),
    )


def peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another replica's winners: some events unseen, some users unknown."""
    from tidemark.operators.merge import latest

    seen = records(spark, sf_dir).where((F.col("event_id") % 5 != 0) & (F.col("user_id") % 13 != 0))
    return latest(seen, "user_id")


RECORDS_SQL = """
WITH v AS (SELECT user_id, event_id, 1 + event_id % 7 AS version, event_type = 'error' AS is_tomb, sha256(CAST(event_id AS VARCHAR)) AS sig, event_id % 4 AS generation FROM events),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC, is_tomb DESC, sig DESC) = 1),
p AS (SELECT * FROM v WHERE event_id % 5 <> 0 AND user_id % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY version DESC, is_tomb DESC, sig DESC) = 1)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 10).alias("room"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("role").alias("author_id"), F.col("text").alias("content"), (F.col("role") == "system").alias("deleted"))
