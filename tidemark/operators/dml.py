"""Adding, editing and removing: read, change, write at the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions import columns as C
from tidemark.functions.validate import app_reason, record_reason, well_formed_subject
from tidemark.operators.merge import State, duplicate_probe, empty_state
from tidemark.operators.search import live_entries
from tidemark.operators.verify import Rejected, key_auth_message, record_message, registry_message, registry_reason
from tidemark.schema import ENTRY, KEY_AUTH, MAX_VERSION, RECORDS, REGISTRY, U64
from tidemark.sources.state import Read, Status


def init_state(spark: SparkSession, root_seed: bytes, online_key: bytes) -> State:
    """A new index: one authorised key, no records."""
    sig = codec.sign(root_seed, key_auth_message(1, [online_key]))
    state = empty_state(spark)
    return State(state.records, spark.sql("select 1").select(F.lit(1).cast(U64).alias("version"), F.array(F.lit(online_key)).alias("authorized"), F.lit(sig).alias("sig")).to(spark.createDataFrame([], KEY_AUTH).schema), state.registry)


def sign_records(records: DataFrame, seed: bytes) -> DataFrame:
    """Sets by and sig; for tools and tests that hold a key."""

    @F.pandas_udf("binary")
    def signed(messages):
        import pandas as pd

        return pd.Series([codec.sign(seed, bytes(m)) for m in messages], dtype=object)

    return records.withColumn("by", F.lit(codec.public_key(seed))).withColumn("sig", signed(record_message()))


def sign_as(records: DataFrame, by: str, seed: str) -> DataFrame:
    """Sets sig by each row's own column `seed`, and by from its column `by`; both are dropped. A key that isn't the seed's makes a forgery, as tests need them."""

    @F.pandas_udf("binary")
    def signed(seeds, messages):
        import pandas as pd

        return pd.Series([codec.sign(bytes(s), bytes(m)) for s, m in zip(seeds, messages, strict=True)], dtype=object)

    made = records.withColumn("_by", F.col(by)).withColumn("_sig", signed(F.col(seed), record_message()))
    return made.drop("by", "sig", by, seed).withColumnsRenamed({"_by": "by", "_sig": "sig"})


def new_records(requests: DataFrame, now: int) -> DataFrame:
    """Unsigned first versions from (subject_id, kind, title, snippet, tags text, locator text, featured, class, pairs).

    Adds reason: the first of what kind, locator or ext refuse.
    """
    kind, at = C.parse_kind("kind"), C.parse_locator("locator")
    ext = C.next_ext(F.lit(None).cast("map<string,string>"), F.col("pairs"), F.lit(False))
    entry = F.struct(
        kind["kind"].alias("kind"), "title", "snippet", C.split_tags("tags").alias("tags"), at["locator"].alias("locator"),
        F.coalesce("featured", F.lit(False)).alias("featured"), F.lit(now).cast(U64).alias("added_at"), "class", F.lit(None).alias("verified"), ext["ext"].alias("ext"),
    ).cast(ENTRY)
    return requests.select("subject_id", F.lit(1).cast(U64).alias("version"), F.lit(False).alias("is_tomb"), entry.alias("entry"), F.coalesce(kind["error"], at["error"], ext["error"]).alias("reason"))


def add(entries: DataFrame, requests: DataFrame, now: int, allow_duplicates: bool = False) -> DataFrame:
    """new_records that may be signed; reason says why the others may not.

    After what parsing refuses: `subject given twice`, then the first rule of structure that is
    broken, then `duplicate` where a listed entry has the same dedup key, or a request whose
    subject comes first.
    """
    made = new_records(requests, now)
    twice = made.groupBy("subject_id").agg(F.count("*").alias("_n")).where("_n > 1")
    structure = record_reason(F.col("version"), well_formed_subject("subject_id"), F.col("is_tomb"), F.col("entry"))
    made = made.join(twice, "subject_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, "subject given twice"), structure)).drop("_n")
    if allow_duplicates:
        return made
    legal = made.where("reason is null").select("subject_id", "entry.locator")
    listed = duplicate_probe(legal, entries).select("subject_id", F.lit(True).alias("_listed"))
    keyed = legal.select("subject_id", C.dedup_key().alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("subject_id").alias("_first"))
    later = keyed.join(first, "_key").where(F.col("subject_id") != F.col("_first")).select("subject_id", F.lit(True).alias("_later"))
    made = made.join(listed, "subject_id", "left").join(later, "subject_id", "left")
    return made.withColumn("reason", F.coalesce("reason", F.when(F.col("_listed") | F.col("_later"), "duplicate"))).drop("_listed", "_later")


def signed_additions(made: DataFrame, seed: bytes) -> DataFrame:
    """The records to send: what add lets pass, signed."""
    return sign_records(as_records(made.where("reason is null")), seed).select(*as_records(made).columns)


def tombstones(removals: DataFrame) -> DataFrame:
    """Records that remove (subject_id, version): one version on; reason `overflow` at the last version."""
    return removals.select(
        "subject_id",
        F.when(F.col("version") < MAX_VERSION, F.col("version").cast(U64) + 1).cast(U64).alias("version"),
        F.lit(True).alias("is_tomb"),
        F.lit(None).cast(ENTRY).alias("entry"),
        F.when(F.col("version") >= MAX_VERSION, "overflow").alias("reason"),
    )


def next_entries(entries: DataFrame, edits: DataFrame, now: int) -> DataFrame:
    """The next version of each edited entry, or reason why there is none.

    edits: subject_id, cur_version and, null where nothing is to change, title, snippet, tags
    (text), featured, class_edit, pairs, ext_clear, status. Kind, locator and added_at stay.
    """
    cur = entries.select("subject_id", *(F.col(c).alias(f"c_{c}") for c in entries.columns if c != "subject_id"))
    both = edits.join(cur, "subject_id", "left")
    none = F.coalesce(*(F.col(c).cast("string") for c in ("title", "snippet", "tags", "featured", "status")), *(F.col(f"class_edit.{c}").cast("string") for c in ("landing", "adult_sections", "volatility", "classifier")), F.when(F.size("pairs") > 0, "x"), F.when(F.col("ext_clear"), "x")).isNull()
    title, snippet = F.coalesce("title", "c_title"), F.coalesce("snippet", "c_snippet")
    changed = (title != F.col("c_title")) | (snippet != F.col("c_snippet"))
    class_, ext = C.next_class(F.col("c_class"), F.col("class_edit"), now), C.next_ext(F.col("c_ext"), F.col("pairs"), F.col("ext_clear"))
    reason = F.coalesce(
        F.when(F.col("c_version").isNull(), "no such entry"), F.when(F.col("c_version") != F.col("cur_version"), "version"), F.when(none, "nothing to change"),
        F.when(F.col("cur_version") >= MAX_VERSION, "overflow"), class_["error"], ext["error"],
    )
    return both.select(
        "subject_id",
        F.when(F.col("cur_version") < MAX_VERSION, F.col("cur_version").cast(U64) + 1).cast(U64).alias("version"),
        F.col("c_kind").alias("kind"), title.alias("title"), snippet.alias("snippet"),
        F.when(F.col("tags").isNotNull(), C.split_tags("tags")).otherwise(F.col("c_tags")).alias("tags"),
        F.col("c_locator").alias("locator"), F.coalesce("featured", "c_featured").alias("featured"), F.col("c_added_at").alias("added_at"),
        class_["class"].alias("class"), C.next_verified(F.col("c_verified"), F.col("status"), changed, now).alias("verified"), ext["ext"].alias("ext"),
        reason.alias("reason"),
    )


def update_gate(state: State, subject_id: str, root: bytes, filed_as: str | None = None) -> str | None:
    """Why the record filed under an id can't be edited; nothing is built on what isn't verified.

    In this order: no key_auth, its signature, no such entry, signer, signature, filed under
    another id, removed.
    """
    if not codec.well_formed_subject(subject_id):
        return "subject id"
    auth = state.key_auth.first()
    if auth is None:
        return "no key_auth"
    keys = [bytes(k) for k in auth["authorized"]]
    if not codec.verify(root, key_auth_message(auth["version"], keys), bytes(auth["sig"])):
        return "key_auth signature"
    found = state.records.where(F.col(filed_as or "subject_id") == subject_id)
    row = found.select("subject_id", "is_tomb", "by", "sig", record_message().alias("_message")).first()
    if row is None:
        return "no such entry"
    if bytes(row["by"] or b"") not in keys:
        return "signer not authorised"
    if not codec.verify(bytes(row["by"]), bytes(row["_message"]), bytes(row["sig"] or b"")):
        return "bad signature"
    if row["subject_id"] != subject_id:
        return "filed under another id"
    return "removed" if row["is_tomb"] else None


def update(state: State, edits: DataFrame, root: bytes, seed: bytes, now: int) -> DataFrame:
    """The signed next record of the one entry that edits name; raises Rejected with the reason there is none."""
    subject_id = edits.first()["subject_id"]
    reason = update_gate(state, subject_id, root)
    if reason:
        raise Rejected(reason)
    made = next_entries(live_entries(state.records.where(F.col("subject_id") == subject_id)), edits, now)
    body = F.struct(*(c for c in made.columns if c not in ("subject_id", "version", "reason"))).cast(ENTRY)
    record = made.select("subject_id", "version", F.lit(False).alias("is_tomb"), body.alias("entry"), "reason")
    structure = record_reason(F.col("version"), well_formed_subject("subject_id"), F.col("is_tomb"), F.col("entry"))
    reason = record.select(F.coalesce("reason", structure).alias("reason")).first()["reason"]
    if reason:
        raise Rejected(reason)
    return signed_additions(record, seed)


def next_registry(current: dict | None, slug: str, app: str, record: dict | None, expect_version: int | None) -> dict:
    """The registry after setting or (record None) removing an app; raises Rejected."""
    version = int(current["version"]) if current else 0
    if expect_version is None:
        raise Rejected("expected version required")
    if expect_version != version:
        raise Rejected(f"registry is at version {version}")
    apps = dict(current["apps"]) if current else {}
    if record is not None:
        reason = app_reason(app, **record)
        if reason:
            raise Rejected(reason)
        apps[app] = record
    elif apps.pop(app, None) is None:
        raise Rejected(f"{app} is not registered")
    if version + 1 > MAX_VERSION:
        raise Rejected("overflow")
    return {"index_slug": slug, "version": version + 1, "apps": apps}


def signed_registry(spark: SparkSession, body: dict, root_seed: bytes) -> DataFrame:
    sig = codec.sign(root_seed, registry_message(body["index_slug"], body["version"], body["apps"]))
    from decimal import Decimal

    apps = {k: (v["contract_id"], v["name"], v["link_template"]) for k, v in body["apps"].items()}
    return spark.createDataFrame([(body["index_slug"], Decimal(body["version"]), apps, bytearray(sig))], REGISTRY)


def verified_registry(read: Read, root: bytes, slug: str) -> DataFrame | None:
    """The registry of what was read, None where there is no state yet; one that doesn't verify raises Rejected."""
    if read.status in (Status.UNFINDABLE, Status.FAILED):
        raise Rejected("the index isn't found, which doesn't prove that it isn't there")
    if read.state is None:
        return None
    reason = registry_reason(read.state.registry, root, slug)
    if reason:
        raise Rejected(reason)
    return read.state.registry


def set_app(read: Read, root_seed: bytes, slug: str, app: str, record: dict | None, expect_version: int | None) -> DataFrame:
    """The signed registry after setting or (record None) removing an app; built on a verified one only, and verified itself."""
    root = codec.public_key(root_seed)
    registry = verified_registry(read, root, slug)
    if registry is None:
        raise Rejected("the index isn't initialised")
    row = registry.first()
    current = row and {"version": int(row["version"]), "apps": {k: v.asDict() for k, v in row["apps"].items()}}
    made = signed_registry(registry.sparkSession, next_registry(current, slug, app, record, expect_version), root_seed)
    reason = registry_reason(made, root, slug)
    if reason:
        raise Rejected(reason)
    return made


def listed_apps(read: Read, root: bytes, slug: str, as_json: bool = False) -> str:
    """The registry for people or as JSON, verified before it is shown."""
    registry = verified_registry(read, root, slug)
    row = registry.first() if registry is not None else None
    if as_json:
        return registry_json(registry) if registry is not None else '{"version":0,"apps":{}}'
    if row is None:
        return "(no app registry)"
    apps = (f"  {k}  {v['name']}  {v['contract_id']}\n     template {v['link_template']}" for k, v in sorted(row["apps"].items()))
    return "\n".join((f"app registry version {int(row['version'])}:", *apps))


def registry_json(registry: DataFrame) -> str:
    """The registry with apps by slug; none is version 0."""
    import json

    row = registry.first()
    if row is None:
        return '{"version":0,"apps":{}}'
    apps = {k: v.asDict() for k, v in sorted((row["apps"] or {}).items())}
    return json.dumps({"version": int(row["version"]), "apps": apps}, separators=(",", ":"))


def as_records(rows: DataFrame) -> DataFrame:
    """Rows in the schema of records, unsigned where they have no signature."""
    spark = rows.sparkSession
    for c in ("by", "sig"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("binary"))
    return rows.select(*spark.createDataFrame([], RECORDS).columns)
