"""The browse and search query: live, safe, ordered, matching, resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.places import with_places


def live_entries(records: DataFrame) -> DataFrame:
    """Entries without tombstones."""
    return records.where(~F.col("is_tomb")).select("subject_id", "version", "entry.*")


def browse_order() -> list:
    """Featured first, then newest; the subject id makes the order total."""
    return [F.desc("featured"), F.desc("added_at"), F.asc("subject_id")]


def list_order() -> list:
    return [F.desc("added_at"), F.asc("subject_id")]


def listed(entries: DataFrame) -> DataFrame:
    """Newest first with the position as rn. All columns are sorted and kept, so select what is needed before."""
    return with_places(entries, list_order())


def search(entries: DataFrame, apps: DataFrame, query: str = "", safe: bool = True) -> DataFrame:
    """Cards in browse order. They are sorted last: the optimizer drops an order below a join."""
    return found(entries, apps, query, safe).orderBy(*browse_order())


def found(entries: DataFrame, apps: DataFrame, query: str = "", safe: bool = True) -> DataFrame:
    """Cards of what the search finds, in no order."""
    return cards(entries.where(C.is_safe(safe) & C.matches(query)), apps)


def cards(entries: DataFrame, apps: DataFrame) -> DataFrame:
    return C.with_href(entries, apps).select(
        "subject_id", "title", "snippet", C.kind_label().alias("kind_label"), C.has_adult_sections().alias("adult_sections"),
        "featured", "added_at", "href", "host_app", C.link_target().alias("target"),
    )


def numbered(cards: DataFrame) -> DataFrame:
    """Adds rn, the place in browse order. All columns are sorted and kept, so select what is needed before."""
    return with_places(cards, browse_order())


def counts(entries: DataFrame, query: str = "", safe: bool = True) -> DataFrame:
    """total: after the safe filter; shown: after the search too; and the line above the results. One pass."""
    totals = entries.where(C.is_safe(safe)).agg(F.count("*").alias("total"), F.count_if(C.matches(query)).alias("shown"))
    return totals.withColumn("line", C.result_line(F.col("shown")))


def unresolvable(entries: DataFrame, apps: DataFrame) -> DataFrame:
    """App resources whose app isn't registered."""
    at = F.col("locator")
    known = F.broadcast(apps.select(F.col("app").alias("_app")))
    return entries.where(at["variant"] == "AppResource").join(known, at["app"] == F.col("_app"), "left_anti")


def unclassified(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("class").isNull())


def work_counts(entries: DataFrame, apps: DataFrame) -> DataFrame:
    """live, unresolvable and unclassified in one pass."""
    return C.with_href(entries, apps).agg(F.count("*").alias("live"), F.count_if(F.col("href").isNull()).alias("unresolvable"), F.count_if(F.col("class").isNull()).alias("unclassified"))


def listing_json(entries: DataFrame) -> DataFrame:
    """One JSON object for each entry; what is absent is an explicit null, snippet and tags aren't shown."""
    row = F.struct("subject_id", "version", "kind", "title", C.locator_uri().alias("locator"), "featured", "added_at", "class", "verified", "ext")
    return entries.select("subject_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


def listing_text(entries: DataFrame, apps: DataFrame) -> DataFrame:
    """The lines of an entry for people; no version is shown."""
    note = F.when(F.col("href").isNull(), "  [UNRESOLVABLE: app not in registry]").otherwise("")
    line = F.concat(
        F.when(F.col("featured"), "★ ").otherwise("  "), "subject_id", F.lit("  ["), "kind", F.lit("]  "), "title",
        F.lit("\n     "), "snippet", F.lit("\n     "), C.locator_uri(), note, F.lit("\n"), C.metadata_lines(),
    )
    return C.with_href(entries, apps).select("subject_id", line.alias("line"))
