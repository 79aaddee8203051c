"""Column builders: pure expressions over entry columns, all inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import BASE58_RUN, CONTRACT_SCHEME, VERIFIED, WEB_PREFIX


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def locator_uri(locator: str | Column = "locator") -> Column:
    """Canonical URI of a locator."""
    at = _col(locator)
    return (
        F.when(at["variant"] == "Contract", F.concat(F.lit(CONTRACT_SCHEME + ":"), at["contract_id"], at["path"]))
        .when(at["variant"] == "External", at["url"])
        .when(at["variant"] == "AppResource", F.concat(F.lit("app:"), at["app"], F.lit("/"), at["resource"], at["path"]))
    )


def dedup_key(locator: str | Column = "locator") -> Column:
    """What two locators of one subject share: app resources drop their path."""
    at = _col(locator)
    return F.when(at["variant"] == "AppResource", F.concat(F.lit("app:"), at["app"], F.lit("/"), at["resource"])).otherwise(locator_uri(at))


def kind_label(kind: str | Column = "kind") -> Column:
    k = _col(kind)
    return F.when(k == "App", "app").when(k == "Site", "site").when(k == "External", "web").otherwise(k)


def has_adult_sections(class_: str | Column = "class") -> Column:
    return F.coalesce(_col(class_)["has_adult_sections"], F.lit(False))


def link_target(locator: str | Column = "locator") -> Column:
    return F.when(_col(locator)["variant"] == "External", "_blank").otherwise("_self")


def web_href(contract_id: Column, suffix: Column) -> Column:
    """A slash stands between id and suffix exactly once."""
    return F.concat(F.lit(WEB_PREFIX), contract_id, F.when(suffix.startswith("/"), F.lit("")).otherwise("/"), suffix)


def resolve_template(template: Column, resource: Column, path: Column) -> Column:
    """Fills in {resource}, then {path}; what {path} brings isn't looked at again."""
    return F.replace(F.replace(template, F.lit("{resource}"), resource), F.lit("{path}"), path)


def with_href(entries: DataFrame, apps: DataFrame, locator: str = "locator") -> DataFrame:
    """Adds href (null: the app isn't registered) and host_app. The registry is bounded at 64 apps, so it is broadcast."""
    at = F.col(locator)
    known = F.broadcast(apps.select(F.col("app").alias("_app"), F.col("contract_id").alias("_id"), F.col("name").alias("_name"), F.col("link_template").alias("_template")))
    href = (
        F.when(at["variant"] == "External", at["url"])
        .when(at["variant"] == "Contract", web_href(at["contract_id"], at["path"]))
        .otherwise(web_href(F.col("_id"), resolve_template(F.col("_template"), at["resource"], at["path"])))
    )
    host = F.when(at["variant"] == "AppResource", F.coalesce("_name", at["app"]))
    return entries.join(known, (at["variant"] == "AppResource") & (at["app"] == F.col("_app")), "left").withColumn("href", href).withColumn("host_app", host).drop("_app", "_id", "_name", "_template")


def is_safe(safe: bool = True, class_: str | Column = "class") -> Column:
    """Not assessed, or landing on general pages; unknown landings are hidden."""
    c = _col(class_)
    return F.lit(True) if not safe else c.isNull() | F.coalesce(c["landing"] == "general", F.lit(False))


def safe_preference(stored: str | None) -> bool:
    """Only the exact stored word switches the filter off."""
    return stored != "off"


def matches(query: str, title: str = "title", snippet: str = "snippet", tags: str = "tags") -> Column:
    """Literal, case-insensitive substring of title, snippet or any tag; an empty query matches all."""
    if not query:
        return F.lit(True)
    q = F.lower(F.lit(query))
    found = F.contains(F.lower(title), q) | F.contains(F.lower(snippet), q) | F.exists(tags, lambda t: F.contains(F.lower(t), q))
    return F.coalesce(found, F.lit(False))


def result_line(shown: Column) -> Column:
    return F.when(shown == 1, "1 result").otherwise(F.concat(shown.cast("string"), F.lit(" results")))


def shown_line(query: str, loaded: bool, shown: Column) -> Column:
    """result_line while one searches in what is loaded, else null."""
    return result_line(shown) if query and loaded else F.lit(None).cast("string")


def empty_line(loaded: bool) -> str:
    """What stands in the place of an empty list."""
    return "Nothing matches." if loaded else "Loading…"


def sorted_ext(ext: str | Column = "ext") -> Column:
    """Entries of a map by key, for comparing, hashing and printing."""
    return F.array_sort(F.map_entries(_col(ext)))


def metadata_lines(class_: str = "class", verified: str = "verified", ext: str = "ext") -> Column:
    """Classification, verification and extension lines of a listing."""
    c, v = F.col(class_), F.col(verified)
    assessed = F.concat(
        F.lit("     class: "), c["landing"], F.lit(" landing, "), F.when(c["has_adult_sections"], "has").otherwise("no"), F.lit(" adult sections, "),
        c["volatility"], F.lit(" (classifier "), c["classifier"].cast("string"), F.lit(", at "), c["classified_at"].cast("string"), F.lit(")"),
    )
    checked = F.concat(F.lit("     verified: "), v["status"], F.lit(" at "), v["last_verified_at"].cast("string"))
    pairs = F.array_join(F.transform(sorted_ext(ext), lambda p: F.concat(p["key"], F.lit("="), p["value"])), "  ")
    return F.concat_ws("\n", F.when(c.isNull(), "     class: NOT CLASSIFIED").otherwise(assessed), F.when(v.isNotNull(), checked), F.when(F.col(ext).isNotNull(), F.concat(F.lit("     ext: "), pairs)))


def parse_kind(text: str | Column) -> Column:
    """struct<kind, error>: app and site are taken, others refused for one of three reasons."""
    k = F.lower(_col(text))
    kind = F.when(k == "app", "App").when(k == "site", "Site")
    error = F.when(kind.isNotNull(), None).when(k == "external", "retired").when(k.isin("room", "document", "media", "feed"), "reserved").otherwise("unknown")
    return F.struct(kind.alias("kind"), error.alias("error"))


def parse_locator(text: str | Column) -> Column:
    """struct<locator, error> before the locator's own check: refused schemes and missing parts."""
    s = _col(text)
    app, own = s.startswith("app:"), s.startswith(CONTRACT_SCHEME + ":")
    rest = F.when(app, F.substring(s, 5, 1 << 30)).otherwise(F.substring(s, len(CONTRACT_SCHEME) + 2, 1 << 30))
    after = F.regexp_extract(rest, r"(?s)^[^/]*/(.*)\z", 1)
    none = F.lit(None).cast("string")
    made = F.when(
        app & F.contains(rest, F.lit("/")),
        F.struct(F.lit("AppResource").alias("variant"), none.alias("contract_id"), none.alias("url"), F.regexp_extract(rest, "^([^/]*)/", 1).alias("app"), F.regexp_extract(after, "^([^/#?]*)", 1).alias("resource"), F.regexp_extract(after, r"(?s)^[^/#?]*(.*)\z", 1).alias("path")),
    ).when(
        own,
        F.struct(F.lit("Contract").alias("variant"), F.regexp_extract(rest, f"^({BASE58_RUN}*)", 1).alias("contract_id"), none.alias("url"), none.alias("app"), none.alias("resource"), F.regexp_extract(rest, rf"(?s)^{BASE58_RUN}*(.*)\z", 1).alias("path")),
    )
    error = F.when(app & ~F.contains(rest, F.lit("/")), "no resource").when(app | own, None).when(s.startswith("https://") | s.startswith("http://"), "web refused").otherwise("scheme")
    return F.struct(made.alias("locator"), error.alias("error"))


def split_tags(text: str | Column) -> Column:
    """Tags between commas, without outer white space (of any script) and without empty ones."""
    cut = F.transform(F.split(_col(text), ","), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))
    return F.filter(cut, lambda t: t != "")


def reconcile_epoch(text: str | Column) -> Column:
    """Seconds of an RFC 3339 time's first 19 characters, its offset ignored; null if it can't be read.

    Six numbers at fixed places. Only months (1 to 12) and days (1 to 31) are checked: what stands
    beyond a month's end, or hour 24, counts on from there.
    """
    s = F.trim(_col(text))
    digits = [F.substring(s, at, n) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    read = reduce(lambda a, b: a & b, (d.rlike(r"\A[+-]?[0-9]+\z") for d in digits)) & (F.octet_length(s) >= 19)
    year, month, day, hour, minute, second = (F.when(read, d).try_cast("long") for d in digits)
    first = F.unix_date(F.make_date(year.cast("int"), F.when(month.between(1, 12), month).cast("int"), F.lit(1)))
    return F.when(day.between(1, 31), (first + day - 1) * 86_400 + hour * 3600 + minute * 60 + second)


def fingerprint(sig: str | Column = "sig") -> Column:
    """The first 8 bytes of a signature."""
    return F.substring(_col(sig), 1, 8)


def next_class(current: Column, edit: Column, now: int) -> Column:
    """struct<class, error>: edit is struct<landing, adult_sections, volatility, classifier>, nulls unset."""
    untouched = edit["landing"].isNull() & edit["adult_sections"].isNull() & edit["volatility"].isNull() & edit["classifier"].isNull()
    landing = F.coalesce(edit["landing"], current["landing"])
    made = F.struct(
        landing.alias("landing"),
        F.coalesce(edit["adult_sections"], current["has_adult_sections"], F.lit(False)).alias("has_adult_sections"),
        F.coalesce(edit["volatility"], current["volatility"], F.lit("static")).alias("volatility"),
        F.coalesce(edit["classifier"], current["classifier"], F.lit(0)).cast("int").alias("classifier"),
        F.lit(now).cast("decimal(20,0)").alias("classified_at"),
    )
    bad = ~untouched & landing.isNull()
    return F.struct(F.when(untouched, current).when(~bad, made).alias("class"), F.when(bad, "landing required").alias("error"))


def next_ext(current: Column, pairs: Column, clear: Column) -> Column:
    """struct<ext, error>: key=value pairs over the current map, or alone after a clear; empty becomes null."""
    pairs = F.coalesce(pairs, F.array().cast("array<string>"))
    key = lambda p: F.substring_index(p, "=", 1)
    keys = F.transform(pairs, key)
    bad = F.exists(pairs, lambda p: ~F.contains(p, F.lit("=")))
    twice = F.size(F.array_distinct(keys)) < F.size(keys)
    empty = F.create_map().cast("map<string,string>")
    new = F.map_from_entries(F.when(bad | twice, F.array().cast("array<struct<k:string,v:string>>")).otherwise(F.transform(pairs, lambda p: F.struct(key(p).alias("k"), F.split(p, "=", 2)[1].alias("v")))))
    merged = F.map_zip_with(F.when(F.coalesce(clear, F.lit(False)), empty).otherwise(F.coalesce(current, empty)), new, lambda k, a, b: F.coalesce(b, a))
    return F.struct(F.when(~bad & ~twice & (F.size(merged) > 0), merged).alias("ext"), F.when(bad, "not key=value").when(twice, "key given twice").alias("error"))


def next_verified(current: Column, status: Column, changed: Column, now: int) -> Column:
    """An explicit status is stamped now; a changed description clears; else nothing changes."""
    stamped = F.struct(F.lit(now).cast("decimal(20,0)").alias("last_verified_at"), status.alias("status")).cast(VERIFIED)
    return F.when(status.isNotNull(), stamped).when(~changed, current)
