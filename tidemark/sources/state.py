"""States in files: one CBOR document, or a Parquet snapshot of three tables."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import cbor_decode
from tidemark.operators.merge import State, merge
from tidemark.schema import CONTRACT_VARIANT, KEY_AUTH, RECORDS, REGISTRY


class Status(Enum):
    PRESENT = "present"
    EMPTY = "empty"
    UNFINDABLE = "unfindable"
    FAILED = "failed"


@dataclass(frozen=True)
class Read:
    """What a place holds; empty and unfindable aren't the same, and no state stands for neither."""

    status: Status
    state: State | None


def _locator(value: dict) -> dict:
    ((variant, fields),) = value.items()
    variant = "Contract" if variant == CONTRACT_VARIANT else variant
    return {"variant": variant, "contract_id": None, "url": None, "app": None, "resource": None, "path": None} | fields


def _entry(e: dict) -> dict:
    number = lambda d, *keys: d and {k: Decimal(v) if k in keys else v for k, v in d.items()}
    return {
        "kind": e["kind"], "title": e["title"], "snippet": e["snippet"], "tags": e["tags"], "locator": _locator(e["locator"]), "featured": e["featured"],
        "added_at": Decimal(e["added_at"]), "class": number(e.get("class"), "classified_at"), "verified": number(e.get("verified"), "last_verified_at"), "ext": e.get("ext"),
    }


def decode_records(document: dict) -> list[tuple]:
    """Rows of RECORDS in order of subject; a missing field raises."""
    rows = []
    for filed, record in sorted(document["records"].items()):
        ((kind, body),) = record["body"].items()
        if body["subject_id"] != filed:
            raise ValueError(f"{filed} holds another id")
        rows.append((filed, Decimal(body["version"]), kind == "Tomb", _entry(body) if kind == "Live" else None, bytearray(record["by"]), bytearray(record["sig"])))
    return rows


def decode_state(spark: SparkSession, data: bytes) -> State:
    """A state from one CBOR document, which the data model bounds at 50 MiB; anything broken raises."""
    doc = cbor_decode(data)
    auth, apps = doc.get("key_auth"), doc.get("apps")
    auths = [(Decimal(auth["body"]["version"]), [bytearray(k) for k in auth["body"]["authorized"]], bytearray(auth["sig"]))] if auth else []
    registries = [(apps["body"]["index_slug"], Decimal(apps["body"]["version"]), {k: (v["contract_id"], v["name"], v["link_template"]) for k, v in apps["body"]["apps"].items()}, bytearray(apps["sig"]))] if apps else []
    return State(spark.createDataFrame(decode_records(doc), RECORDS), spark.createDataFrame(auths, KEY_AUTH), spark.createDataFrame(registries, REGISTRY))


def read_document(spark: SparkSession, path: str) -> Read:
    """A CBOR file: present, empty (no bytes) or unfindable; a broken one raises."""
    data = read_raw(spark, path)
    if data is None:
        return Read(Status.UNFINDABLE, None)
    return Read(Status.PRESENT, decode_state(spark, data)) if data else Read(Status.EMPTY, None)


def read_raw(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of one file, None if there is none."""
    if not _exists(spark, path):
        return None
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"]) if row else b""


def count_live_or_zero(spark: SparkSession, path: str) -> int:
    """Live entries of a document; here alone what can't be decoded counts as none."""
    try:
        read = read_document(spark, path)
    except (ValueError, KeyError, UnicodeDecodeError):
        return 0
    return read.state.records.where(~F.col("is_tomb")).count() if read.state else 0


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


PARTS = ("records", "key_auth", "registry")


def write_snapshot(state: State, path: str) -> None:
    """Parquet, one folder for each part; a snapshot is written once."""
    for part in PARTS:
        getattr(state, part).write.mode("errorifexists").parquet(f"{path}/{part}")


def read_snapshot(spark: SparkSession, path: str) -> Read:
    if not _exists(spark, f"{path}/records"):
        return Read(Status.UNFINDABLE, None)
    schemas = dict(zip(PARTS, (RECORDS, KEY_AUTH, REGISTRY), strict=True))
    return Read(Status.PRESENT, State(*(spark.read.schema(schemas[p]).parquet(f"{path}/{p}") for p in PARTS)))


def put(spark: SparkSession, state: State, old: str, new: str) -> State:
    """Merges a state over the snapshot at old and writes the result to new."""
    there = read_snapshot(spark, old)
    merged = merge(there.state, state) if there.state else state
    write_snapshot(merged, new)
    return read_snapshot(spark, new).state


def copy(spark: SparkSession, source: str, target: str, new: str) -> DataFrame:
    """Merges the snapshot at source into the one at target; counts of the result."""
    from tidemark.operators.merge import count_live_tomb

    there = read_snapshot(spark, source)
    if there.state is None:
        raise FileNotFoundError(source)
    return count_live_tomb(put(spark, there.state, target, new).records)
