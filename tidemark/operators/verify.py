"""Verification of whole states: all violations as rows, then one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.functions.validate import app_reason, record_reason, signature_ok, well_formed_subject, wire_bytes
from tidemark.operators.merge import State, is_empty_delta, latest, merge, pick_registry
from tidemark.schema import MAX_APPS, MAX_KEYS, MAX_RECORDS


class Rejected(ValueError):
    """An input that a gate refuses, with its first reason."""


def record_message() -> Column:
    """The bytes a record's signature covers: its body in the wire encoding."""
    return wire_bytes(F.to_json(F.struct("subject_id", "version", "is_tomb", "entry")))


def key_auth_message(version: int, keys: list[bytes]) -> bytes:
    return codec.cbor_encode({"version": int(version), "authorized": [bytes(k) for k in keys]})


def registry_message(slug: str, version: int, apps: dict) -> bytes:
    fields = ("contract_id", "name", "link_template")
    return codec.cbor_encode({"version": int(version), "index_slug": slug, "apps": {k: {f: v[f] for f in fields} for k, v in sorted(apps.items())}})


def _authorized(key_auth: DataFrame) -> list[bytes]:
    row = key_auth.first()
    return [bytes(k) for k in row["authorized"]] if row else []


def record_violations(records: DataFrame, keys: list[bytes], order: tuple[str, ...] = ("id", "authorised", "signature", "structure"), filed_as: str | None = None) -> DataFrame:
    """(subject_id, reason) of each bad record, the first in the given order. At most 32 keys."""
    checks = {
        "id": F.when(F.col(filed_as) != F.col("subject_id"), "filed under another id") if filed_as else F.lit(None).cast("string"),
        "authorised": F.when(~F.coalesce(F.array_contains(F.array(*(F.lit(k) for k in keys)).cast("array<binary>"), F.col("by")), F.lit(False)), "signer not authorised"),
        "signature": F.when(~F.col("_signed"), "bad signature"),
        "structure": record_reason(F.col("version"), well_formed_subject("subject_id"), F.col("is_tomb"), F.col("entry")),
    }
    signed = records.withColumn("_signed", signature_ok("by", record_message(), "sig"))
    return signed.select("subject_id", F.coalesce(*(checks[c] for c in order)).alias("reason")).where("reason is not null")


def registry_problem(root: bytes, slug: str, index_slug: str, version: int, apps: dict, sig: bytes | None) -> str | None:
    """Signature, binding to the index, then structure."""
    if not codec.verify(root, registry_message(index_slug, version, apps), bytes(sig or b"")):
        return "registry signature"
    if index_slug != slug:
        return "registry of another index"
    if version < 1:
        return "registry version"
    if len(apps) > MAX_APPS:
        return "too many apps"
    return next((f"app {k}: {r}" for k, v in sorted(apps.items()) if (r := app_reason(k, **v))), None)


def registry_reason(registry: DataFrame, root: bytes, slug: str) -> str | None:
    """registry_problem of the registry, if there is one; it is one row of 64 apps at most."""
    row = registry.first()
    return row and registry_problem(root, slug, row["index_slug"], row["version"], {k: v.asDict() for k, v in (row["apps"] or {}).items()}, row["sig"])


def head_reason(state: State, root: bytes, slug: str) -> str | None:
    row = state.key_auth.first()
    if row is None:
        return "no key_auth"
    keys = [bytes(k) for k in row["authorized"]]
    if not codec.verify(root, key_auth_message(row["version"], keys), bytes(row["sig"])):
        return "key_auth signature"
    if len(keys) > MAX_KEYS:
        return "too many keys"
    return registry_reason(state.registry, root, slug)


def verify_state(state: State, root: bytes, slug: str, filed_as: str | None = None) -> str | None:
    """The first reason a state is refused, or None. All or nothing."""
    reason = head_reason(state, root, slug)
    if reason:
        return reason
    if state.records.count() > MAX_RECORDS:
        return "too many records"
    bad = record_violations(state.records, _authorized(state.key_auth), filed_as=filed_as).orderBy("subject_id").limit(1).collect()
    return f"{bad[0]['subject_id']}: {bad[0]['reason']}" if bad else None


def preflight(state: State, root: bytes, slug: str, filed_as: str | None = None) -> tuple[str | None, DataFrame]:
    """The state's reason, and each record's first failure in the order structure, signature, id."""
    return verify_state(state, root, slug, filed_as), record_violations(state.records, _authorized(state.key_auth), ("structure", "signature", "id"), filed_as)


def validate(data: State | None, root: bytes, slug: str) -> bool:
    """Nothing at all is valid; else the state must verify."""
    return data is None or verify_state(data, root, slug) is None


def apply_delta(state: State, d: State, root: bytes, slug: str) -> State:
    """The state with an untrusted delta, or Rejected with nothing changed."""
    own, new = state.key_auth.first(), d.key_auth.first()
    if new is not None:
        keys = [bytes(k) for k in new["authorized"]]
        if not codec.verify(root, key_auth_message(new["version"], keys), bytes(new["sig"])):
            raise Rejected("key_auth signature")
        if len(keys) > MAX_KEYS:
            raise Rejected("too many keys")
        if own is not None and own != new:
            raise Rejected("key_auth can't change")
    reason = registry_reason(d.registry, root, slug)
    if reason:
        raise Rejected(reason)
    if own is None and new is None:
        raise Rejected("no key_auth")
    auth = state.key_auth if own is not None else d.key_auth
    bad = record_violations(d.records, _authorized(auth), ("authorised", "signature", "structure")).orderBy("subject_id").limit(1).collect()
    if bad:
        raise Rejected(f"{bad[0]['subject_id']}: {bad[0]['reason']}")
    records = latest(state.records.unionByName(d.records))
    if records.count() > MAX_RECORDS:
        raise Rejected("too many records")
    return State(records, auth, pick_registry(state.registry.unionByName(d.registry)))


def update_state(state: State, updates: list[tuple], root: bytes, slug: str) -> State:
    """Folds ("state", State), ("delta", State) and ("both", State, State); the result must verify."""
    for kind, *parts in updates:
        if kind not in ("state", "delta", "both"):
            raise Rejected(f"unknown update {kind}")
        if kind in ("state", "both"):
            reason = verify_state(parts[0], root, slug)
            if reason:
                raise Rejected(reason)
            state = merge(state, parts[0])
        if kind in ("delta", "both") and not is_empty_delta(parts[-1]):
            state = apply_delta(state, parts[-1], root, slug)
    reason = verify_state(state, root, slug)
    if reason:
        raise Rejected(reason)
    return state
