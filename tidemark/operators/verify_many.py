"""Verification, untrusted deltas and exchanges of many indexes at once: the decisions of verify.py as rows by index.

Each index is decided as a whole, by its first reason in the same order; nothing of an index comes
to the driver. Signatures are checked where the rows lie, before anything is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.validate import record_reason, signature_ok, well_formed_subject
from tidemark.operators.merge import delta_records, latest, pick_registry, summarize_records
from tidemark.operators.places import durable
from tidemark.operators.verify import key_auth_message, record_message, registry_problem
from tidemark.schema import MAX_KEYS, MAX_RECORDS

KEY = ("index_slug", "subject_id")


@dataclass(frozen=True)
class Indexes:
    """records (index_slug and a record's columns), key_auths (index_slug, version, authorized, sig), registries (index_slug of whose state it is part, and registry: the signed one) and roots (index_slug, root), which are known."""

    records: DataFrame
    key_auths: DataFrame
    registries: DataFrame
    roots: DataFrame


@F.pandas_udf(T.BinaryType())
def key_auth_bytes(versions, keys):
    import pandas as pd

    return pd.Series([key_auth_message(v, list(k)) for v, k in zip(versions, keys, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def registry_problems(roots, slugs, registries, sigs):
    """registry_problem of each registry, given as JSON, with its signature."""
    import json

    import pandas as pd

    out = []
    for root, slug, text, sig in zip(roots, slugs, registries, sigs, strict=True):
        r = json.loads(text)
        out.append(registry_problem(bytes(root), slug, r.get("index_slug"), int(r.get("version") or 0), r.get("apps") or {}, sig))
    return pd.Series(out, dtype=object)


def record_reasons(records: DataFrame, key_auths: DataFrame, order: tuple[str, ...] = ("id", "authorised", "signature", "structure"), filed_as: str | None = None) -> DataFrame:
    """(index_slug, subject_id, reason) of each bad record: the first in the given order."""
    keys = key_auths.select("index_slug", F.col("authorized").alias("_keys"))
    checks: dict[str, Column] = {
        "id": F.when(F.col(filed_as) != F.col("subject_id"), "filed under another id") if filed_as else F.lit(None).cast("string"),
        "authorised": F.when(~F.coalesce(F.array_contains("_keys", F.col("by")), F.lit(False)), "signer not authorised"),
        "signature": F.when(~F.col("_signed"), "bad signature"),
        "structure": record_reason(F.col("version"), well_formed_subject("subject_id"), F.col("is_tomb"), F.col("entry")),
    }
    signed = records.withColumn("_signed", signature_ok("by", record_message(), "sig")).join(keys, "index_slug", "left")
    return signed.select(*KEY, F.coalesce(*(checks[c] for c in order)).alias("reason")).where("reason is not null")


def _key_auth_reasons(key_auths: DataFrame, roots: DataFrame) -> DataFrame:
    checked = key_auths.join(roots, "index_slug").withColumn("_signed", signature_ok("root", key_auth_bytes("version", "authorized"), "sig"))
    return checked.select("index_slug", F.when(~F.col("_signed"), "key_auth signature").when(F.size("authorized") > MAX_KEYS, "too many keys").alias("_auth"))


def _registry_reasons(registries: DataFrame, roots: DataFrame) -> DataFrame:
    told = registry_problems("root", "index_slug", F.to_json("registry", {"ignoreNullFields": "false"}), "registry.sig")
    return registries.join(roots, "index_slug").select("index_slug", told.alias("_registry")).where("_registry is not null").groupBy("index_slug").agg(F.min("_registry").alias("_registry"))


def _first_records(reasons: DataFrame) -> DataFrame:
    first = F.min(F.struct("subject_id", "reason"))
    return reasons.groupBy("index_slug").agg(first.alias("_b")).select("index_slug", F.concat_ws(": ", "_b.subject_id", "_b.reason").alias("_record"))


def verify_indexes(ix: Indexes, filed_as: str | None = None) -> DataFrame:
    """(index_slug, reason) of each index with a known root; null where its state stands."""
    held = ix.key_auths.select("index_slug", F.lit(True).alias("_held"))
    sizes = ix.records.groupBy("index_slug").agg(F.count("*").alias("_n"))
    out = ix.roots.select("index_slug")
    for part in (held, _key_auth_reasons(ix.key_auths, ix.roots), _registry_reasons(ix.registries, ix.roots), sizes, _first_records(record_reasons(ix.records, ix.key_auths, filed_as=filed_as))):
        out = out.join(part, "index_slug", "left")
    reason = F.coalesce(F.when(F.col("_held").isNull(), "no key_auth"), "_auth", "_registry", F.when(F.col("_n") > MAX_RECORDS, "too many records"), "_record")
    return out.select("index_slug", reason.alias("reason"))


def apply_deltas(ix: Indexes, delta: Indexes) -> tuple[Indexes, DataFrame]:
    """The indexes with what the deltas bring, and (index_slug, reason) of those whose delta is refused as a whole and that stay as they are."""
    own = ix.key_auths.select("index_slug", F.struct("version", "authorized", "sig").alias("_own"))
    new = delta.key_auths.select("index_slug", F.struct("version", "authorized", "sig").alias("_new"))
    first = delta.key_auths.join(ix.key_auths.select("index_slug"), "index_slug", "left_anti")
    auths = ix.key_auths.unionByName(first)
    merged = latest(ix.records.unionByName(delta.records), list(KEY))
    sizes = merged.groupBy("index_slug").agg(F.count("*").alias("_n")).where(F.col("_n") > MAX_RECORDS)
    told = ix.roots.select("index_slug")
    for part in (own, new, _key_auth_reasons(delta.key_auths, ix.roots), _registry_reasons(delta.registries, ix.roots), _first_records(record_reasons(delta.records, auths, ("authorised", "signature", "structure"))), sizes):
        told = told.join(part, "index_slug", "left")
    changed = F.when(F.col("_own").isNotNull() & F.col("_new").isNotNull() & (F.col("_own") != F.col("_new")), "key_auth can't change")
    none = F.when(F.col("_own").isNull() & F.col("_new").isNull(), "no key_auth")
    reason = F.coalesce("_auth", changed, "_registry", none, "_record", F.when(F.col("_n").isNotNull(), "too many records"))
    asked = delta.records.select("index_slug").unionByName(delta.key_auths.select("index_slug")).unionByName(delta.registries.select("index_slug")).distinct()
    refused = durable(told.select("index_slug", reason.alias("reason")).where("reason is not null").join(asked, "index_slug", "left_semi"))  # decided once
    taken = lambda rows: rows.join(refused.select("index_slug"), "index_slug", "left_anti")
    registries = ix.registries.unionByName(taken(delta.registries)).select(F.col("index_slug").alias("_of"), "registry.*")
    picked = pick_registry(registries.drop("index_slug").withColumnRenamed("_of", "index_slug"))
    fields = delta.registries.schema["registry"].dataType.fieldNames()
    after = Indexes(
        latest(ix.records.unionByName(taken(delta.records)), list(KEY)),
        ix.key_auths.unionByName(taken(first)),
        picked.select("index_slug", F.struct(*fields).alias("registry")),
        ix.roots,
    )
    return after, refused


def lacking(mine: Indexes, theirs: Indexes) -> Indexes:
    """What theirs lacks of mine, told by a summary: records that are missing, older or other there, and the key_auths and registries of indexes where theirs has none or an older one."""
    records = delta_records(mine.records, summarize_records(theirs.records, KEY), KEY)
    auths = mine.key_auths.join(theirs.key_auths.select("index_slug", F.col("version").alias("_v")), "index_slug", "left").where(F.col("_v").isNull() | (F.col("version") > F.col("_v"))).drop("_v")
    there = theirs.registries.select("index_slug", F.col("registry.version").alias("_v"), F.substring("registry.sig", 1, 8).alias("_fp"))
    newer = F.col("_v").isNull() | (F.col("registry.version") > F.col("_v")) | (F.col("registry.version") == F.col("_v")) & (F.substring("registry.sig", 1, 8) != F.col("_fp"))
    registries = mine.registries.join(there, "index_slug", "left").where(newer).drop("_v", "_fp")
    return Indexes(records, auths, registries, mine.roots)


def exchange(a: Indexes, b: Indexes) -> tuple[Indexes, Indexes]:
    """Both after each has taken what it lacked of the other, verified; they then hold the same records."""
    return apply_deltas(a, lacking(b, a))[0], apply_deltas(b, lacking(a, b))[0]
