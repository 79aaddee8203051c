"""Small driver-side files: registered generations and pointer records, in TOML."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import contract_id


def lineage(spark: SparkSession, text: str, params: bytes) -> DataFrame:
    """generation, code_hash, instance of each entry, newest first; instances follow from code and params."""
    rows = [(int(e["generation"]), e["code_hash"], contract_id(bytes.fromhex(e["code_hash"]), params)) for e in tomllib.loads(text).get("entry", [])]
    return spark.createDataFrame(rows, "generation int, code_hash string, instance string").orderBy(F.desc("generation"))


def top_level(text: str, key: str) -> str | None:
    """A key outside of all tables; None if it isn't there or is a table itself."""
    value = tomllib.loads(text).get(key)
    return None if value is None or isinstance(value, dict | list) else str(value)


def pointer_ids(text: str) -> list[str]:
    """The ids of all records, in their order; none at all is an error."""
    records = tomllib.loads(text).get("record", [])
    if not records:
        raise ValueError("no records")
    return [r.get("app_id") for r in records]


def pointer_index(text: str, app_id: str) -> int:
    """The place of a record by its exact id; one that is missing or stands twice is an error."""
    at = [i for i, own in enumerate(pointer_ids(text)) if own == app_id]
    if len(at) != 1:
        raise ValueError(f"{len(at)} records of {app_id}")
    return at[0]


def pointer_records(spark: SparkSession, text: str) -> DataFrame:
    """The [[record]] tables; none at all is an error."""
    records = tomllib.loads(text).get("record", [])
    if not records:
        raise ValueError("no records")
    fields = ("app_id", "wasm_path", "pointer_key", "version", "code_hash", "state")
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in records], "app_id string, wasm_path string, pointer_key string, version bigint, code_hash string, state string")
