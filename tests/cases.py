"""Cases over literal inputs with their answers: gates that take or refuse a whole state, and formats with known answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec, validate
from tidemark.functions import columns as C
from tidemark.operators import dml, merge, migrate, places, pointers, verify
from tidemark.plans.registry import values
from tidemark.schema import MAX_RECORDS, RECORDS
from tidemark.sources import lineage, messages, state

CASES: dict[str, tuple[Callable, str]] = {}


def query(sql: str):
    """Keeps a case with the SQL of its answers."""

    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


#: Keys for literal states alone: of the index, of its writer, of a stranger.
ROOT, WRITER, STRANGER = b"\2" * 32, b"\1" * 32, b"\3" * 32
SLUG = "default"


def told(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "item string, outcome string")


def answers(rows: list[tuple]) -> str:
    return values("item, outcome", rows)


def outcome(act: Callable[[], object]) -> str:
    """What act returns, or the reason it raises."""
    try:
        got = act()
        return "accepted" if got is None else str(got)
    except (verify.Rejected, ValueError) as e:
        return str(e)


def subject(n: int) -> str:
    return codec.base58_encode(bytes([n]) * 9)


def entry(title: str) -> dict:
    at = {"variant": "AppResource", "contract_id": None, "url": None, "app": "garden", "resource": "abc", "path": ""}
    return {"kind": "Site", "title": title, "snippet": "", "tags": ["x"], "locator": at, "featured": False, "added_at": Decimal(5), "class": None, "verified": None, "ext": None}


def signed(spark: SparkSession, rows: list[tuple], seed: bytes = WRITER) -> DataFrame:
    """rows: (n, version, title or None for a tombstone)."""
    made = [(subject(n), Decimal(v), t is None, None if t is None else entry(t), None, None) for n, v, t in rows]
    return spark.createDataFrame(dml.sign_records(spark.createDataFrame(made, RECORDS), seed).collect(), RECORDS)  # signed once


def index(spark: SparkSession, rows: list[tuple], seed: bytes = WRITER) -> merge.State:
    return merge.with_records(dml.init_state(spark, ROOT, codec.public_key(WRITER)), signed(spark, rows, seed))


def shown(records: DataFrame) -> str:
    """n, version and title of records, in order."""
    rows = records.select("subject_id", "version", F.coalesce("entry.title", F.lit("-")).alias("title")).collect()
    return " ".join(f"{n}:{version}:{title}" for n, version, title in sorted((codec.base58_decode(r.subject_id)[0], int(r.version), r.title) for r in rows))


GARDEN = {"contract_id": "3" * 44, "name": "Garden", "link_template": "/#{resource}{path}"}


def registry(spark: SparkSession, apps: dict, slug: str = SLUG, seed: bytes = ROOT) -> DataFrame:
    return dml.signed_registry(spark, {"index_slug": slug, "version": 1, "apps": apps}, seed)


STATES = [
    ("as made", "accepted"), ("nothing at all", "True"), ("a tombstone alone", "accepted"), ("with an app", "accepted"), ("without key_auth", "no key_auth"), ("under another root", "key_auth signature"),
    ("too many keys", "too many keys"), ("a stranger's record", "1: signer not authorised"), ("a raised version", "1: bad signature"), ("an empty title", "1: title length"), ("filed elsewhere", "1: filed under another id"),
    ("another index's registry", "registry of another index"), ("a registry under another root", "registry signature"), ("too many apps", "too many apps"), ("too many records", "too many records"),
]


@query(answers(STATES))
def state_verification(spark, sf_dir):
    """The first reason whole states are refused for."""
    key, good = codec.public_key(ROOT), index(spark, [(1, 1, "a"), (2, 1, None)])
    keys = [codec.public_key(bytes([i]) * 32) for i in range(33)]
    crowd = good.key_auth.select(F.lit(1).cast("decimal(20,0)").alias("version"), F.array(*map(F.lit, keys)).alias("authorized"), F.lit(codec.sign(ROOT, verify.key_auth_message(1, keys))).alias("sig"))
    many = spark.range(MAX_RECORDS + 1).select(F.col("id").cast("string").alias("subject_id")).join(good.records.limit(1).drop("subject_id"))
    apps = {f"app{i}": GARDEN for i in range(65)}
    state_of = {
        "as made": good, "a tombstone alone": index(spark, [(1, 1, None)]), "with an app": merge.State(good.records, good.key_auth, registry(spark, {"garden": GARDEN})), "without key_auth": merge.empty_state(spark),
        "under another root": good, "too many keys": merge.State(good.records, crowd, good.registry), "a stranger's record": index(spark, [(1, 1, "a")], STRANGER), "an empty title": index(spark, [(1, 1, "")]),
        "a raised version": merge.with_records(good, signed(spark, [(1, 1, "a")]).withColumn("version", (F.col("version") + 1).cast("decimal(20,0)"))), "filed elsewhere": merge.with_records(good, good.records.withColumn("filed", F.lit(subject(2)))),
        "another index's registry": merge.State(good.records, good.key_auth, registry(spark, {}, "other")), "a registry under another root": merge.State(good.records, good.key_auth, registry(spark, {}, seed=STRANGER)),
        "too many apps": merge.State(good.records, good.key_auth, registry(spark, apps)), "too many records": merge.with_records(good, many),
    }

    def judge(name: str) -> str | bool | None:
        if name == "nothing at all":
            return verify.validate(None, key, SLUG)
        root = codec.public_key(STRANGER) if name == "under another root" else key
        reason = verify.verify_state(state_of[name], root, SLUG, "filed" if name == "filed elsewhere" else None)
        return reason and reason.replace(subject(1), "1")

    return told(spark, [(name, outcome(lambda: judge(name))) for name, _ in STATES])


DELTAS = [
    ("a newer record", "1:2:b 2:1:-"), ("an older record", "1:1:a 2:1:-"), ("a revived subject", "1:1:a 2:2:c"), ("a stranger's record", "3: signer not authorised"), ("a broken record", "3: title length"),
    ("another key_auth", "key_auth can't change"), ("a registry of another index", "registry of another index"), ("an empty delta", "1:1:a 2:1:-"), ("a state", "1:1:a 2:1:- 3:1:d"), ("both", "1:2:b 2:1:- 3:1:d"), ("an unknown kind", "unknown update else"),
]


@query(answers(DELTAS))
def delta_application(spark, sf_dir):
    """What untrusted updates make of a state, or why they are refused with nothing changed."""
    key, mine = codec.public_key(ROOT), index(spark, [(1, 1, "a"), (2, 1, None)])
    none = merge.empty_state(spark)
    delta = lambda rows, seed=WRITER: ("delta", merge.with_records(none, signed(spark, rows, seed)))
    other = dml.init_state(spark, ROOT, codec.public_key(STRANGER))
    newer, third = delta([(1, 2, "b")])[1], index(spark, [(3, 1, "d")])
    update_of = {
        "a newer record": delta([(1, 2, "b")]), "an older record": delta([(1, 1, "a")]), "a revived subject": delta([(2, 2, "c")]), "a stranger's record": delta([(3, 1, "s")], STRANGER), "a broken record": delta([(3, 1, "")]),
        "another key_auth": ("delta", merge.State(none.records, other.key_auth, none.registry)), "a registry of another index": ("delta", merge.State(none.records, none.key_auth, registry(spark, {}, "other"))),
        "an empty delta": ("delta", none), "a state": ("state", third), "both": ("both", third, newer), "an unknown kind": ("else", none),
    }
    return told(spark, [(name, outcome(lambda: shown(verify.update_state(mine, [update_of[name]], key, SLUG).records)).replace(subject(3), "3")) for name, _ in DELTAS])


@query(answers([("mine", "1:2:x 2:1:- 3:1:z"), ("theirs", "1:2:x 2:1:- 3:1:z"), ("then lacking", "True"), ("key_auth and apps versions", "1 0")]))
def anti_entropy(spark, sf_dir):
    """Two replicas exchange what the other lacks, and then lack nothing."""
    a, b = index(spark, [(1, 2, "x"), (2, 1, None)]), index(spark, [(1, 1, "old"), (2, 1, "alive"), (3, 1, "z")])
    theirs, mine = merge.anti_entropy(a, b), merge.anti_entropy(b, a)
    head = merge.summarize_head(mine).first().asDict()
    nothing = merge.is_empty_delta(merge.delta(theirs, merge.summarize_records(mine.records), head))
    return told(spark, [("mine", shown(mine.records)), ("theirs", shown(theirs.records)), ("then lacking", str(nothing)), ("key_auth and apps versions", f"{int(head['key_auth_version'])} {int(head['apps_version'])}")])


@query(answers([("by structure first", "1: title length"), ("the state", "1: signer not authorised")]))
def preflight(spark, sf_dir):
    """A generation's records one by one: structure, signature, id; the state as a whole by its own order."""
    reason, items = verify.preflight(index(spark, [(1, 1, "")], STRANGER), codec.public_key(ROOT), SLUG)
    return told(spark, [("by structure first", " ".join(f"{r.subject_id}: {r.reason}" for r in items.collect()).replace(subject(1), "1")), ("the state", reason.replace(subject(1), "1"))])


EDITS = [
    ("the first app", "1 garden"), ("another app", "2 garden,pond"), ("one less", "3 pond"), ("no expected version", "expected version required"), ("an old version", "registry is at version 1"), ("removing what isn't there", "pond is not registered"),
    ("a bad slug", "app slug"), ("a bad template", "no {path}"), ("as JSON", '{"version":1,"apps":{"garden":{"contract_id":"' + "3" * 44 + '","name":"Garden","link_template":"/#{resource}{path}"}}}'), ("none as JSON", '{"version":0,"apps":{}}'), ("signed", "accepted"),
]


@query(answers(EDITS))
def registry_edits(spark, sf_dir):
    """The registry after setting and removing apps, or why it stays."""
    first = dml.next_registry(None, SLUG, "garden", GARDEN, 0)
    second = dml.next_registry(first, SLUG, "pond", GARDEN, 1)
    text = lambda body: f"{body['version']} {','.join(sorted(body['apps']))}"
    made = dml.signed_registry(spark, first, ROOT)
    acts = {
        "the first app": lambda: text(first), "another app": lambda: text(second), "one less": lambda: text(dml.next_registry(second, SLUG, "garden", None, 2)), "no expected version": lambda: dml.next_registry(first, SLUG, "pond", GARDEN, None),
        "an old version": lambda: dml.next_registry(first, SLUG, "pond", GARDEN, 0), "removing what isn't there": lambda: dml.next_registry(first, SLUG, "pond", None, 1), "a bad slug": lambda: dml.next_registry(first, SLUG, "Pond", GARDEN, 1),
        "a bad template": lambda: dml.next_registry(first, SLUG, "pond", GARDEN | {"link_template": "/{resource}"}, 1), "as JSON": lambda: dml.registry_json(made), "none as JSON": lambda: dml.registry_json(made.limit(0)),
        "signed": lambda: verify.registry_reason(made, codec.public_key(ROOT), SLUG),
    }
    return told(spark, [(name, outcome(acts[name])) for name, _ in EDITS])


GATES = [
    ("sound", "accepted"), ("malformed", "subject id"), ("unknown", "no such entry"), ("removed", "removed"), ("a stranger's", "signer not authorised"), ("forged", "bad signature"), ("filed elsewhere", "filed under another id"),
    ("no key_auth", "no key_auth"), ("another root", "key_auth signature"), ("an update", "1:2:b"), ("an old version", "version"), ("no change", "nothing to change"), ("a long title", "title length"),
]


@query(answers(GATES))
def update_gates(spark, sf_dir):
    """Why a record isn't edited, in the order of the checks, and what an edit makes."""
    key, s = codec.public_key(ROOT), index(spark, [(1, 1, "a"), (2, 1, None)])
    strange, forged = index(spark, [(1, 1, "a")], STRANGER), merge.with_records(s, s.records.withColumn("version", (F.col("version") + 1).cast("decimal(20,0)")))
    filed = merge.with_records(s, s.records.withColumn("filed", F.when(F.col("subject_id") == subject(1), subject(2)).otherwise(subject(1))))
    none = F.lit(None)

    def edit(title: str | None, version: int) -> DataFrame:
        return spark.range(1).select(
            F.lit(subject(1)).alias("subject_id"), F.lit(version).cast("decimal(20,0)").alias("cur_version"), F.lit(title).cast("string").alias("title"), none.cast("string").alias("snippet"), none.cast("string").alias("tags"), none.cast("boolean").alias("featured"),
            none.cast("struct<landing:string,adult_sections:boolean,volatility:string,classifier:int>").alias("class_edit"), none.cast("array<string>").alias("pairs"), F.lit(False).alias("ext_clear"), none.cast("string").alias("status"),
        )

    acts = {
        "sound": lambda: dml.update_gate(s, subject(1), key), "malformed": lambda: dml.update_gate(s, "0", key), "unknown": lambda: dml.update_gate(s, subject(9), key), "removed": lambda: dml.update_gate(s, subject(2), key),
        "a stranger's": lambda: dml.update_gate(strange, subject(1), key), "forged": lambda: dml.update_gate(forged, subject(1), key), "filed elsewhere": lambda: dml.update_gate(filed, subject(2), key, "filed"),
        "no key_auth": lambda: dml.update_gate(merge.empty_state(spark), subject(1), key), "another root": lambda: dml.update_gate(s, subject(1), codec.public_key(STRANGER)), "an update": lambda: shown(dml.update(s, edit("b", 1), key, WRITER, 9)),
        "an old version": lambda: dml.update(s, edit("b", 2), key, WRITER, 9), "no change": lambda: dml.update(s, edit(None, 1), key, WRITER, 9), "a long title": lambda: dml.update(s, edit("b" * 201, 1), key, WRITER, 9),
    }
    return told(spark, [(name, outcome(acts[name])) for name, _ in GATES])


GENERATIONS = [
    ("dry, one unread", "not acknowledged: ['g3']; failed: ['g0']"), ("dry, all answered", "False"), ("real, one unread", "g0: unreadable"), ("real, not acknowledged", "not acknowledged: ['g3']; failed: []"),
    ("real", "g1:present/2/0 g2:present/0/1 g3:unfindable/0/0 g4:present/1/0 1:1:a 2:2:- 3:1:b"), ("a foreign state", "1: signer not authorised"),
]


@query(answers(GENERATIONS))
def migration(spark, sf_dir):
    """Folding generations: what is read, refused, written and read back."""
    present = lambda rows, seed=WRITER: state.Read(state.Status.PRESENT, index(spark, rows, seed))
    places = {"g4": present([(1, 1, "a")]), "g3": state.Read(state.Status.UNFINDABLE, None), "g2": present([(2, 2, None)]), "g1": present([(2, 1, "x"), (3, 1, "b")]), "foreign": present([(1, 1, "a")], STRANGER)}
    written: list[merge.State] = []

    def read(g: str) -> state.Read:
        if g == "g0":
            raise ValueError("unreadable")
        return places[g]

    def run(names: str, acks: str = "", dry: bool = False) -> dict:
        return migrate.migrate(names.split(), read, written.append, lambda: written[-1].records, codec.public_key(ROOT), SLUG, set(acks.split()), dry)

    def real() -> str:
        got = run("g4 g3 g2 g1", "g3")
        return " ".join(f"{g}:{'/'.join(map(str, r))}" for g, r in sorted(got["report"].items())) + " " + shown(written[-1].records)

    acts = {
        "dry, one unread": lambda: run("g4 g3 g0", dry=True), "dry, all answered": lambda: run("g4 g3", "g3", True)["written"], "real, one unread": lambda: run("g4 g0"), "real, not acknowledged": lambda: run("g4 g3"),
        "real": real, "a foreign state": lambda: run("foreign").get("written"),
    }
    return told(spark, [(name, outcome(acts[name]).replace(subject(1) + ":", "1:")) for name, _ in GENERATIONS])


DOCUMENT = {
    "key_auth": None,
    "records": {
        subject(1): {"body": {"Live": {"subject_id": subject(1), "version": 2**64 - 1, "kind": "Site", "title": "t", "snippet": "", "tags": [], "locator": {"External": {"url": "https://x"}}, "featured": True, "added_at": 1}}, "by": b"\1" * 32, "sig": b"\2" * 64},
        subject(2): {"body": {"Tomb": {"subject_id": subject(2), "version": 3}}, "by": b"", "sig": b""},
    },
}


@query(answers([("records", f"1:{2**64 - 1}:t 2:3:-"), ("a byte too many", "bytes after the item"), ("cut short", "truncated"), ("filed under another id", "another id"), ("what is signed", "True"), ("no key_auth", "0")]))
def documents(spark, sf_dir):
    """States out of CBOR documents; whatever is broken is refused, and what is signed are the document's own bytes."""
    data = codec.cbor_encode(DOCUMENT)
    wrong = {"key_auth": None, "records": {subject(3): DOCUMENT["records"][subject(2)]}}
    s = state.decode_state(spark, data)
    messages_ = {r.subject_id: bytes(r.m) for r in s.records.select("subject_id", verify.record_message().alias("m")).collect()}
    same = all(messages_[k] == codec.cbor_encode(v["body"]) for k, v in DOCUMENT["records"].items())
    acts = [
        ("records", lambda: shown(s.records)), ("a byte too many", lambda: state.decode_state(spark, data + b"\0")), ("cut short", lambda: state.decode_state(spark, data[:-1])),
        ("filed under another id", lambda: state.decode_state(spark, codec.cbor_encode(wrong))), ("what is signed", lambda: same), ("no key_auth", lambda: s.key_auth.count()),
    ]
    return told(spark, [(name, outcome(act).removeprefix(f"{subject(3)} holds ")) for name, act in acts])


# Published vectors of BLAKE3 (bytes 0, 1, ... 250, 0, ...) and of ed25519, and base58 of known bytes.
VECTORS = [
    ("blake3 0", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), ("blake3 1", "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
    ("blake3 1024", "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"), ("blake3 1025", "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"),
    ("public key", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"),
    ("signature of nothing", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("base58", "StV1DL6CwTryKyV"), ("base58 of zeros", "111"), ("contract id", "blake3 base58"), ("params", "default True"), ("params cut short", "None"), ("params not UTF-8", "None"),
    ("cbor", "a2646b696e646453697465616e07"), ("minted ids", "True 2"),
]


@query(answers(VECTORS))
def known_answers(spark, sf_dir):
    """Hashes, keys, signatures and encodings of published inputs."""
    seed, key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"), codec.public_key(ROOT)
    run = lambda n: bytes(i % 251 for i in range(n))
    parsed = codec.params_parse(codec.params_encode(key, "default"))
    made = codec.contract_id(run(32), b"params") == codec.base58_encode(codec.blake3(run(32) + b"params"))
    got = [codec.blake3(run(n)).hex() for n in (0, 1, 1024, 1025)] + [codec.public_key(seed).hex(), codec.sign(seed, b"").hex(), codec.base58_encode(b"hello world"), codec.base58_encode(bytes(3)), "blake3 base58" if made else "other"]
    got += [f"{parsed[1]} {parsed[0] == key}", str(codec.params_parse(key[:31])), str(codec.params_parse(key + b"\xff"))]
    minted = {codec.mint_subject(), codec.mint_subject()}
    got += [codec.cbor_encode({"kind": "Site", "n": 7}).hex(), f"{all(map(codec.well_formed_subject, minted))} {len(minted)}"]
    return told(spark, [(name, x) for (name, _), x in zip(VECTORS, got, strict=True)])


TIMES = [
    ("2026-08-03T21:49:41Z", 1785793781), ("2026-08-03 21:49:41+05:00", 1785793781), (" 2026-08-03T21:49:41.123Z ", 1785793781), ("1970-01-01T00:00:00Z", 0), ("2026-02-30T00:00:00Z", 1772409600), ("2026-08-03T24:00:00Z", 1785801600),
    ("2026-13-01T00:00:00Z", None), ("2026-00-01T00:00:00Z", None), ("2026-01-32T00:00:00Z", None), ("2026-01-00T00:00:00Z", None), ("2026-08-03", None), ("", None), ("yesterday, at some hour", None),
]


@query(values("text, seconds, same", [(t, n, True) for t, n in TIMES]))
def reconcile_times(spark, sf_dir):
    """Seconds of RFC 3339 texts, as an expression and as the replica's reader takes them."""
    rows = spark.createDataFrame([(t, messages.epoch(t)) for t, _ in TIMES], "text string, own long")
    return rows.select("text", C.reconcile_epoch("text").alias("seconds"), C.reconcile_epoch("text").eqNullSafe(F.col("own")).alias("same"))


POINTERS = '''
format = 2
[[record]]
app_id = "garden"
wasm_path = "a.wasm"
pointer_key = "k"
version = 3
code_hash = "h"
state = "s"
[[record]]
app_id = "pond"
version = 1
'''
FILES = [
    ("format", "2"), ("missing key", "None"), ("a table's key", "None"), ("ids", "garden,pond"), ("pond is at", "1"), ("unknown", "0 records of lake"), ("twice", "2 records of pond"), ("none", "no records"), ("records", "garden:3:h pond:1:None"),
    ("generations", "2,1"), ("instances", "2"), ("anchored", "True"), ("not anchored", "False"),
]


@query(answers(FILES))
def files_of_records(spark, sf_dir):
    """Pointer records by id and place, registered generations newest first, and a key alone on a line."""
    generations = '[[entry]]\ngeneration = 1\ncode_hash = "00"\n[[entry]]\ngeneration = 2\ncode_hash = "01"\n'
    lines = spark.createDataFrame([("k1",), ("prefix k2",)], "value string")
    acts = {
        "format": lambda: lineage.top_level(POINTERS, "format"), "missing key": lambda: str(lineage.top_level(POINTERS, "app_id")), "a table's key": lambda: str(lineage.top_level(POINTERS, "record")), "ids": lambda: ",".join(lineage.pointer_ids(POINTERS)),
        "pond is at": lambda: lineage.pointer_index(POINTERS, "pond"), "unknown": lambda: lineage.pointer_index(POINTERS, "lake"), "twice": lambda: lineage.pointer_index(POINTERS + '[[record]]\napp_id = "pond"\n', "pond"), "none": lambda: lineage.pointer_records(spark, "").count(),
        "records": lambda: " ".join(f"{r.app_id}:{r.version}:{r.code_hash}" for r in lineage.pointer_records(spark, POINTERS).orderBy("app_id").collect()), "generations": lambda: ",".join(str(r.generation) for r in lineage.lineage(spark, generations, b"p").collect()),
        "instances": lambda: lineage.lineage(spark, generations, b"p").select("instance").distinct().count(), "anchored": lambda: pointers.anchored(lines, "k1"), "not anchored": lambda: pointers.anchored(lines, "k2"),
    }
    return told(spark, [(name, outcome(acts[name])) for name, _ in FILES])


LINES = [("one found", "1 result"), ("several", "3 results"), ("no search", None), ("not loaded yet", None), ("empty", "Nothing matches."), ("loading", "Loading…")]


@query(answers(LINES))
def result_lines(spark, sf_dir):
    """The line above results, which stands only while one searches in what is loaded, and what stands for none."""
    n = spark.createDataFrame([(1, 3)], "one int, three int")
    row = n.select(C.shown_line("q", True, F.col("one")), C.shown_line("q", True, F.col("three")), C.shown_line("", True, F.col("three")), C.shown_line("q", False, F.col("three"))).first()
    return told(spark, [(name, x) for (name, _), x in zip(LINES, [*row, C.empty_line(True), C.empty_line(False)], strict=True)])


NULLS = [
    ("nothing missing", None), ("version", "version"), ("title", "title length"), ("snippet", "snippet length"), ("tags", "tags"), ("kind", "kind"), ("locator", "unknown variant"), ("featured", "missing field"), ("added_at", "missing field"),
    ("the entry", "title length"), ("a path", "no path"), ("a url", "not https"), ("a class's landing", "landing"),
]


@query(answers(NULLS))
def missing_fields(spark, sf_dir):
    """Records with a field missing are refused, whichever it is; class, verified and ext may be."""
    e = entry("t")
    at = e["locator"]
    changed = {
        "nothing missing": e, "version": e, "the entry": None, "a path": e | {"locator": at | {"path": None}}, "a url": e | {"locator": at | {"variant": "External"}},
        "a class's landing": e | {"class": {"landing": None, "has_adult_sections": False, "volatility": "static", "classifier": 0, "classified_at": Decimal(1)}},
    }
    rows = [(subject(i), None if name == "version" else Decimal(1), False, changed.get(name, e | {name: None}), None, None) for i, (name, _) in enumerate(NULLS)]
    reason = validate.record_reason(F.col("version"), validate.well_formed_subject("subject_id"), F.col("is_tomb"), F.col("entry"))
    got = {r.subject_id: r.reason for r in spark.createDataFrame(rows, RECORDS).select("subject_id", reason.alias("reason")).collect()}
    return told(spark, [(name, got[subject(i)]) for i, (name, _) in enumerate(NULLS)])


APPS = [
    ("not found", "the index isn't found, which doesn't prove that it isn't there"), ("not initialised", "the index isn't initialised"), ("the first app", "app registry version 1:\n  garden  Garden  " + "3" * 44 + "\n     template /#{resource}{path}"),
    ("another app", "2"), ("upon a forged registry", "registry signature"), ("upon another index's", "registry of another index"), ("shown where none is", "(no app registry)"), ("a forged one shown", "registry signature"), ("none as JSON", '{"version":0,"apps":{}}'),
]


@query(answers(APPS))
def app_commands(spark, sf_dir):
    """Setting and listing apps: nothing is built on, or shown of, what isn't verified."""
    key, base = codec.public_key(ROOT), dml.init_state(spark, ROOT, codec.public_key(WRITER))
    present = lambda r=base.registry: state.Read(state.Status.PRESENT, merge.State(base.records, base.key_auth, r))
    none = {"not found": state.Read(state.Status.UNFINDABLE, None), "not initialised": state.Read(state.Status.EMPTY, None)}
    first = dml.set_app(present(), ROOT, SLUG, "garden", GARDEN, 0)
    add = lambda read: dml.set_app(read, ROOT, SLUG, "pond", GARDEN, 1).first()["version"]
    acts = {
        "not found": lambda: add(none["not found"]), "not initialised": lambda: add(none["not initialised"]), "the first app": lambda: dml.listed_apps(present(first), key, SLUG), "another app": lambda: add(present(first)),
        "upon a forged registry": lambda: add(present(registry(spark, {"garden": GARDEN}, seed=STRANGER))), "upon another index's": lambda: add(present(registry(spark, {}, "other"))), "shown where none is": lambda: dml.listed_apps(present(), key, SLUG),
        "a forged one shown": lambda: dml.listed_apps(present(registry(spark, {}, seed=STRANGER)), key, SLUG), "none as JSON": lambda: dml.listed_apps(none["not initialised"], key, SLUG, as_json=True),
    }
    return told(spark, [(name, outcome(acts[name])) for name, _ in APPS])


FOLDERS = [
    ("missing", "unfindable None"), ("empty", "empty None"), ("full", f"present 1:{2**64 - 1}:t 2:3:-"), ("raw bytes of missing", "None"), ("raw bytes", "True"), ("live or none", "1"), ("live or none of broken", "0"), ("no snapshot", "unfindable None"),
    ("snapshot", "present 1:1:a 2:1:-"), ("put over it", "1:2:b 2:1:- 3:1:c"), ("written twice", "refused"), ("copied over it", "2 1"), ("copied from nowhere", "refused"),
]


@query(answers(FOLDERS))
def documents_and_snapshots(spark, sf_dir):
    """Reading one document and Parquet snapshots, merging a state over one, copying one over another."""
    folder = f"{places.shared_folder(spark)}/states_{uuid.uuid4().hex}"
    places.remove(spark, folder, at_exit=True)

    def file(name: str, data: bytes) -> str:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(data))
        out.close()
        return f"{folder}/{name}"

    def refused(act: Callable[[], object]) -> str:
        try:
            act()
        except Exception:  # noqa: BLE001  a store says no in its own way
            return "refused"
        return "taken"

    said = lambda r: f"{r.status.value} {shown(r.state.records) if r.state else None}"
    data = codec.cbor_encode(DOCUMENT)
    missing, empty, full, broken = f"{folder}/missing", file("empty", b""), file("full", data), file("broken", data + b"\0")
    state.write_snapshot(index(spark, [(1, 1, "a"), (2, 1, None)]), f"{folder}/a")
    state.write_snapshot(index(spark, [(1, 2, "b"), (3, 1, "c")]), f"{folder}/b")
    put = state.put(spark, index(spark, [(1, 2, "b"), (3, 1, "c")]), f"{folder}/a", f"{folder}/c")
    copied = state.copy(spark, f"{folder}/b", f"{folder}/a", f"{folder}/d").first()
    got = [
        said(state.read_document(spark, missing)), said(state.read_document(spark, empty)), said(state.read_document(spark, full)), str(state.read_raw(spark, missing)), str(state.read_raw(spark, full) == data),
        str(state.count_live_or_zero(spark, full)), str(state.count_live_or_zero(spark, broken)), said(state.read_snapshot(spark, missing)), said(state.read_snapshot(spark, f"{folder}/a")), shown(put.records),
        refused(lambda: state.write_snapshot(put, f"{folder}/a")), f"{copied['live']} {copied['tombstones']}", refused(lambda: state.copy(spark, missing, f"{folder}/a", f"{folder}/e")),
    ]
    return told(spark, [(name, x) for (name, _), x in zip(FOLDERS, got, strict=True)])
