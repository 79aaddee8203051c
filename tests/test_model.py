"""Rules that the tables can't show: hostile inputs, merge laws, signatures, gates, files."""

import hashlib
import random
import sqlite3
from decimal import Decimal
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import codec, html, validate
from tidemark.operators import dml, merge, migrate, search, verify
from tidemark.schema import RECORDS
from tidemark.sources import lineage, messages, state
from tidemark.streaming.lww import into_snapshots, into_states, last_snapshot

SEED, ROOT = b"\1" * 32, b"\2" * 32


def sid(n: int) -> str:
    return codec.base58_encode(bytes([n]) * 9)


def entry(title="A title", **over):
    at = {"variant": "AppResource", "contract_id": None, "url": None, "app": "garden", "resource": "abc", "path": ""}
    return {"kind": "Site", "title": title, "snippet": "", "tags": ["x"], "locator": at, "featured": False, "added_at": Decimal(5), "class": None, "verified": None, "ext": None} | over


def records(spark, rows, seed=SEED):
    """rows: (n, version, title or None for a tombstone)."""
    made = [(sid(n), Decimal(v), t is None, None if t is None else entry(t), None, None) for n, v, t in rows]
    return dml.sign_records(spark.createDataFrame(made, RECORDS), seed)


def index(spark, rows):
    base = dml.init_state(spark, ROOT, codec.public_key(SEED))
    return merge.with_records(base, records(spark, rows))


def picked(s):
    return sorted((r.subject_id, int(r.version), r.is_tomb, r.entry.title if r.entry else None) for r in s.records.collect())


@pytest.mark.parametrize(
    "path,reason",
    [
        ("", None), ("/", None), ("/a/b?q=1#f", None), ("#frag..x", None), ("/%zz%", None), ("/a%252e", None),
        ("/../x", "dot segment"), ("/%2e%2e/x", "dot segment"), ("/..%2fx", "dot segment"), ("/%252e%252e%252f", "dot segment"), ("..\\x", "dot segment"), ("/a/.%2e", "dot segment"),
        ("//x", "absolute escape"), ("/\\x", "absolute escape"), ("/%2fx", "absolute escape"), ("c:/x", "absolute escape"), ("/C%3a", "absolute escape"),
        ("/%c0%ae", "invalid utf-8"), ("/%ff", "invalid utf-8"), ("/a%00", "control character"), ("/a\n", "control character"), ("/%7f", "control character"), ("/" + "a" * 512, "path length"),
    ],
)
def test_paths(path, reason):
    assert codec.path_reason(path) == reason


@pytest.mark.parametrize("layers,ok", [(1, True), (7, True), (8, True), (9, False), (10, False)])
def test_decoding_is_bounded(layers, ok):
    text = b"%61"
    for _ in range(layers - 1):
        text = text.replace(b"%", b"%25")
    assert (codec.decode_bounded(text) is not None) == ok


@given(st.binary(max_size=40))
def test_base58_round_trip(data):
    assert codec.base58_decode(codec.base58_encode(data)) == data


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.text(max_size=8) | st.binary(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12))
@settings(max_examples=60)
def test_cbor_round_trip(value):
    assert codec.cbor_decode(codec.cbor_encode(value)) == value
    with pytest.raises(ValueError):
        codec.cbor_decode(codec.cbor_encode(value) + b"\0")


def test_hash_and_signature_vectors():
    assert codec.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert len({codec.blake3(b"a" * n) for n in (63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000)}) == 9
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key, sig = codec.public_key(seed), codec.sign(seed, b"m")
    assert key.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert codec.verify(key, b"m", sig) and not codec.verify(key, b"n", sig) and not codec.verify(key, b"m", sig[:63])
    small = (1).to_bytes(32, "little")
    assert not codec.verify(small, b"m", small + bytes(32))
    high = sig[:32] + (int.from_bytes(sig[32:], "little") + codec.ORDER).to_bytes(32, "little")
    assert not codec.verify(key, b"m", high)


def test_signatures_by_the_plain_equation():
    """verify_all against s B = R + k A by doubling and adding, over good, broken, non-canonical and small-order rows."""
    rng, rows = random.Random(4), []
    seeds = [rng.randbytes(32) for _ in range(4)]
    for i in range(24):
        seed, message = rng.choice(seeds), rng.randbytes(i)
        key, sig = codec.public_key(seed), codec.sign(seed, message)
        broken = bytearray(sig)
        broken[rng.randrange(64)] ^= 1 << rng.randrange(8)
        rows += [(key, message, sig), (key, message, bytes(broken)), (key, message + b"!", sig)]
    key, message, sig = rows[0]
    for odd in (*(n.to_bytes(32, "little") for n in (0, 1, codec.P - 1, codec.P, codec.P + 1, 2)), b"\xff" * 32, (1 | 1 << 255).to_bytes(32, "little")):
        rows += [(odd, message, sig), (key, message, odd + sig[32:]), (key, message, odd + bytes(32))]
    neutral = (1).to_bytes(32, "little")
    k = int.from_bytes(hashlib.sha512(neutral + key + b"m").digest(), "little")
    own = next(s for s in seeds if codec.public_key(s) == key)
    rows.append((key, b"m", neutral + (k * codec._secret(own)[0] % codec.ORDER).to_bytes(32, "little")))  # holds, but R is of small order

    def plain(key, message, sig):
        a, r, s = codec._point(key), codec._point(sig[:32]), int.from_bytes(sig[32:], "little")
        if a is None or r is None or s >= codec.ORDER or any(codec._times(8, p)[0] % codec.P == 0 for p in (a, r)):
            return False
        k = int.from_bytes(hashlib.sha512(sig[:32] + key + message).digest(), "little") % codec.ORDER
        return codec._bytes(codec._times(s, codec.BASE)) == codec._bytes(codec._add(r, codec._times(k, a)))

    want = [plain(*r) for r in rows]
    nulls = [(None, b"", sig), (key, None, sig), (key, b"", None), (b"", b"", b"")]
    assert sum(want) == 24 and codec.verify_all(*map(list, zip(*rows, *nulls, strict=True))) == want + [False] * 4


def test_params():
    key = codec.public_key(ROOT)
    assert codec.params_parse(codec.params_encode(key, "default")) == (key, "default")
    assert codec.params_parse(key[:31]) is None and codec.params_parse(key + b"\xff") is None


@pytest.mark.parametrize(
    "template,reason",
    [
        ("/#{resource}{path}", None), ("/x/{resource}/{path}", None), ("{resource}{path}", "template start"), ("/{path}", "no {resource}"), ("/{resource}", "no {path}"),
        ("/{path}/{resource}", "{path} before {resource}"), ("/{resource}{path}2e", "{path} not last"), ("/{resource}/..{path}", "dot segment"), ("/{resource}{x}{path}", "unknown placeholder"),
        ("/%2e{resource}{path}", "template charset"), ("//{resource}{path}", "absolute escape"), ("", "template length"), ("/" + "a" * 128, "template length"),
    ],
)
def test_templates(template, reason):
    assert validate.app_reason("garden", "3" * 44, "Garden", template) == reason


def test_structure_reasons(spark):
    bad = [
        ({"title": ""}, "title length"), ({"title": "é" * 101}, "title length"), ({"title": "a\x1b"}, "title control character"), ({"snippet": "x" * 501}, "snippet length"), ({"tags": ["a\n"]}, "tag control character"),
        ({"tags": ["x"] * 17}, "tags"), ({"tags": ["x" * 41]}, "tags"), ({"kind": "a b"}, "kind"), ({"kind": "x\n"}, "kind"), ({"ext": {str(i): "" for i in range(9)}}, "too many ext keys"),
        ({"ext": {"": "v"}}, "ext entry"), ({"ext": {"k": "v" * 64}}, "ext total"), ({"class": {"landing": "", "has_adult_sections": False, "volatility": "static", "classifier": 0, "classified_at": Decimal(1)}}, "landing"),
        ({"locator": {"variant": "Contract", "contract_id": "1" * 42, "path": ""}}, "contract id length"), ({"locator": {"variant": "Contract", "contract_id": "0" * 43, "path": ""}}, "contract id charset"),
        ({"locator": {"variant": "External", "url": "http://x"}}, "not https"), ({"locator": {"variant": "External", "url": "https://x/%0a"}}, "url control character"), ({"locator": {"variant": "External", "url": "https://x/../y"}}, None),
        ({"locator": {"variant": "AppResource", "app": "De", "resource": "a", "path": ""}}, "app slug"), ({"locator": {"variant": "AppResource", "app": "d", "resource": "l", "path": ""}}, "resource charset"),
        ({"locator": {"variant": "AppResource", "app": "d", "resource": "a", "path": "/../x"}}, "dot segment"), ({}, None),
    ]
    df = spark.createDataFrame([(sid(i), Decimal(1), False, entry(**o), None, None) for i, (o, _) in enumerate(bad)], RECORDS)
    got = {r.subject_id: r.reason for r in df.select("subject_id", validate.record_reason(F.col("version"), validate.well_formed_subject("subject_id"), F.col("is_tomb"), F.col("entry")).alias("reason")).collect()}
    assert [got[sid(i)] for i in range(len(bad))] == [r for _, r in bad]


def test_merge_laws(spark):
    a, b, c = (index(spark, x) for x in ([(1, 1, "a"), (2, 3, "b")], [(1, 2, "new"), (3, 1, "c")], [(2, 3, None), (3, 1, "c2")]))
    results = {tuple(picked(merge.fold(list(p)))) for p in permutations((a, b, c))}
    assert len(results) == 1
    assert picked(merge.merge(merge.merge(a, b), c)) == picked(merge.merge(a, merge.merge(b, c))) == list(results.pop())
    assert picked(merge.merge(a, a)) == picked(a)
    assert (sid(2), 3, True, None) in picked(merge.fold([a, b, c]))


def test_delta_brings_peers_together(spark):
    a, b = index(spark, [(1, 2, "x"), (2, 1, "y")]), index(spark, [(1, 1, "old"), (2, 1, "other")])
    mine, theirs = merge.anti_entropy(b, a), merge.anti_entropy(a, b)
    assert picked(mine) == picked(theirs)
    assert merge.is_empty_delta(merge.delta(mine, merge.summarize_records(mine.records), merge.summarize_head(mine).first().asDict()))


def test_state_gates(spark):
    key = codec.public_key(ROOT)
    s = index(spark, [(1, 1, "a"), (2, 1, None)])
    assert verify.verify_state(s, key, "default") is None and verify.validate(None, key, "default")
    assert verify.verify_state(merge.empty_state(spark), key, "default") == "no key_auth"
    assert verify.verify_state(s, codec.public_key(SEED), "default") == "key_auth signature"
    stranger = merge.with_records(s, records(spark, [(1, 1, "a")], b"\3" * 32))
    assert verify.verify_state(stranger, key, "default").endswith("signer not authorised")
    forged = merge.with_records(s, s.records.withColumn("version", F.col("version") + 1).select(*s.records.columns))
    assert verify.verify_state(forged, key, "default").endswith("bad signature")
    _, itemised = verify.preflight(merge.with_records(s, records(spark, [(1, 1, "")], b"\3" * 32)), key, "default")
    assert [r.reason for r in itemised.collect()] == ["title length"]
    d = merge.with_records(merge.empty_state(spark), records(spark, [(1, 2, "b")]))
    assert (sid(1), 2, False, "b") in picked(verify.update_state(s, [("delta", d)], key, "default"))
    with pytest.raises(verify.Rejected):
        verify.apply_delta(s, stranger, key, "default")
    with pytest.raises(verify.Rejected):
        verify.update_state(s, [("else", d)], key, "default")


def test_registry_edits(spark):
    rec = {"contract_id": "3" * 44, "name": "Garden", "link_template": "/#{resource}{path}"}
    with pytest.raises(verify.Rejected):
        dml.next_registry(None, "default", "garden", rec, None)
    body = dml.next_registry(None, "default", "garden", rec, 0)
    assert body["version"] == 1
    with pytest.raises(verify.Rejected):
        dml.next_registry(body, "default", "other", None, 1)
    with pytest.raises(verify.Rejected):
        dml.next_registry(body, "default", "garden", None, 0)
    reg = dml.signed_registry(spark, body, ROOT)
    assert verify.registry_reason(reg, codec.public_key(ROOT), "default") is None
    assert verify.registry_reason(reg, codec.public_key(ROOT), "else") == "registry of another index"
    assert dml.registry_json(reg) == '{"version":1,"apps":{"garden":{"contract_id":"' + "3" * 44 + '","name":"Garden","link_template":"/#{resource}{path}"}}}'
    assert dml.registry_json(reg.limit(0)) == '{"version":0,"apps":{}}'


def test_migration_folds_all_generations(spark, tmp_path):
    key, A = codec.public_key(ROOT), state.Status
    gens = {"g4": state.Read(A.PRESENT, index(spark, [(1, 1, "a")])), "g3": state.Read(A.UNFINDABLE, None), "g2": state.Read(A.PRESENT, index(spark, [(2, 2, None)])), "g1": state.Read(A.PRESENT, index(spark, [(2, 1, "x"), (3, 1, "b")]))}
    out = str(tmp_path / "new")
    run = lambda **k: migrate.migrate(list(gens), gens.__getitem__, lambda s: state.write_snapshot(s, out), lambda: state.read_snapshot(spark, out).state.records, key, "default", **k)
    with pytest.raises(verify.Rejected):
        run(dry_run=True)
    got = run(acks={"g3"})
    assert got["readback"] == (2, 1) and got["report"]["g2"] == ("present", 0, 1)


def test_documents_and_snapshots(spark, tmp_path):
    missing, empty, full = (str(tmp_path / n) for n in ("missing", "empty", "full"))
    open(empty, "wb").close()
    body = {"subject_id": sid(1), "version": 2**64 - 1, "kind": "Site", "title": "t", "snippet": "", "tags": [], "locator": {"External": {"url": "https://x"}}, "featured": True, "added_at": 1}
    doc = {"key_auth": None, "records": {sid(1): {"body": {"Live": body}, "by": b"\1" * 32, "sig": b"\2" * 64}, sid(2): {"body": {"Tomb": {"subject_id": sid(2), "version": 3}}, "by": b"", "sig": b""}}}
    with open(full, "wb") as f:
        f.write(codec.cbor_encode(doc))
    assert state.read_document(spark, missing).status is state.Status.UNFINDABLE
    assert state.read_document(spark, empty).status is state.Status.EMPTY
    got = state.read_document(spark, full).state
    assert picked(got) == sorted([(sid(1), 2**64 - 1, False, "t"), (sid(2), 3, True, None)])
    assert state.count_live_or_zero(spark, full) == 1
    with open(full, "ab") as f:
        f.write(b"\0")
    assert state.count_live_or_zero(spark, full) == 0
    with pytest.raises(ValueError):
        state.read_document(spark, full)
    assert search.live_entries(got.records).count() == 1
    state.write_snapshot(got, str(tmp_path / "a"))
    assert picked(state.put(spark, got, str(tmp_path / "a"), str(tmp_path / "b"))) == picked(got)


def replica(path, version="1", at="2026-08-03T21:49:41Z", ok=1):
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE meta(key, value); CREATE TABLE messages(seq INTEGER, room, message_id, author_id, content, deleted); CREATE TABLE mirror_state(room, last_reconcile_ok_at, generation_ok)")
        db.execute("INSERT INTO meta VALUES ('schema_version', ?)", [version])
        db.execute("INSERT INTO mirror_state VALUES ('r', ?, ?)", [at, ok])
        db.executemany("INSERT INTO messages VALUES (?, ?, '', 'a', ?, ?)", [(i, "r" if i % 3 else "q", f"m{i}", int(i == 5)) for i in range(12)])


def test_replica(spark, tmp_path):
    now, path = 1785793781 + 60, str(tmp_path / "db")
    replica(path)
    assert messages.check_replica(path, "r", now) is None
    assert messages.check_replica(path, "r", now + 2400) == "stale"
    assert messages.check_replica(path, "r", now - 100) == "reconciled in the future"
    assert messages.check_replica(path, "x", now) == "no state for the room"
    for i, (over, reason) in enumerate([({"version": "2"}, "schema version"), ({"ok": 0}, "generation not attested"), ({"at": ""}, "never reconciled")]):
        replica(f"{path}{i}", **over)
        assert messages.check_replica(f"{path}{i}", "r", now) == reason
    with pytest.raises(sqlite3.OperationalError):
        messages.check_replica(path + "none", "r", now)
    spark.dataSource.register(messages.ReplicaSource)
    got = spark.read.format("tidemark_replica").options(path=path, room="r", cursor=1, partitions=3).load()
    assert [r.seq for r in got.orderBy("seq").collect()] == [2, 4, 7, 8, 10, 11]


def test_late_rows_change_nothing_in_a_stream(spark, tmp_path):
    schema = "subject_id string, version long, is_tomb boolean, sig string"
    for i, rows in enumerate([[("a", 3, False, "x"), ("b", 1, False, "y")], [("a", 2, True, "z"), ("b", 1, True, "a")], [("a", 3, False, "y")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = into_snapshots(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination()
    assert len(run.recentProgress) >= 3
    assert sorted(map(tuple, last_snapshot(run, spark, str(tmp_path / "out"), schema).collect())) == [("a", 3, False, "y"), ("b", 1, True, "a")]


def test_delta_sink(spark, tmp_path):
    """Streamed deltas are judged and folded into the state; a stranger's stops the stream with nothing written."""
    key, kept = codec.public_key(ROOT), [index(spark, [(1, 1, "a")])]
    folder = str(tmp_path / "in")

    def run(name):
        stream = spark.readStream.schema(spark.createDataFrame([], RECORDS).schema).option("recursiveFileLookup", "true").parquet(folder)
        return into_states(stream, lambda: kept[-1], kept.append, lambda s, d: verify.apply_delta(s, d, key, "default"), str(tmp_path / name))

    records(spark, [(1, 2, "b"), (2, 1, None)]).write.parquet(f"{folder}/0")
    run("ck").awaitTermination()
    assert picked(kept[-1]) == sorted([(sid(1), 2, False, "b"), (sid(2), 1, True, None)]) and len(kept) == 2
    records(spark, [(3, 1, "s")], b"\3" * 32).write.parquet(f"{folder}/1")
    with pytest.raises(Exception, match="signer not authorised"):
        run("ck").awaitTermination()
    assert len(kept) == 2


def test_replica_stream(spark, tmp_path):
    """Two runs over a replica: the second gets what has arrived since, batch by batch."""
    path, out = str(tmp_path / "db"), str(tmp_path / "out")
    replica(path)
    spark.dataSource.register(messages.ReplicaSource)

    def run():
        stream = spark.readStream.format("tidemark_replica").options(path=path, room="r", cursor=1, batch=2).load()
        seen = []
        query = stream.writeStream.foreachBatch(lambda df, n: seen.extend(r.seq for r in df.collect())).option("checkpointLocation", out).start()
        query.processAllAvailable()
        query.stop()
        return seen

    assert run() == [2, 4, 7, 8, 10, 11]
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO messages VALUES (13, 'r', '', 'a', 'late', 0)")
    assert run() == [13]


def test_worst_case_fits_the_cap():
    """20,000 records as large as the bounds allow stay under 50 MiB in the wire encoding."""
    from tidemark import schema as S

    word, number = "x" * S.MAX_VOCAB, 2**64 - 1
    body = entry("t" * S.MAX_TITLE, snippet="s" * S.MAX_SNIPPET, tags=["g" * S.MAX_TAG] * S.MAX_TAGS, kind=word, added_at=number)
    body["class"] = {"landing": word, "has_adult_sections": False, "volatility": word, "classifier": 2**16 - 1, "classified_at": number}
    body |= {"verified": {"last_verified_at": number, "status": word}, "ext": {str(i): "v" * (7 if i else 7) for i in range(S.MAX_EXT_KEYS)}}
    app = {"variant": "AppResource", "app": "a" * S.MAX_APP_SLUG, "resource": "r" * S.MAX_RESOURCE, "path": "p" * S.MAX_PATH}
    assert sum(len(k) + len(v) for k, v in body["ext"].items()) == S.MAX_EXT_BYTES
    subject = "z" * 13
    wire = codec.record_bytes({"subject_id": subject, "version": number, "is_tomb": False, "entry": body | {"locator": app}})
    whole = len(codec.cbor_encode(subject)) + len(codec.cbor_encode({"body": 0, "by": bytes(32), "sig": [255] * 64})) - 1 + len(wire)
    assert 2400 < whole and whole * S.MAX_RECORDS < 50 << 20


def test_reports_don_t_pass_through_one_task(spark, sf_dir):
    from tidemark.plans import catalogue

    for name in ("browse_safe", "browse_all", "search_term", "search_literal_percent", "search_tag", "list_recent"):
        df = getattr(catalogue, name)(spark, sf_dir)
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
        places = [r.rn for r in df.collect()]
        assert sorted(places) == list(range(1, len(places) + 1))


def test_a_folder_of_caches_is_no_subpackage(tmp_path):
    """Without the corpus operators, or with no more than their caches left, the other queries still register."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'browse_safe' in e.queries() and not any(q.startswith('op') for q in e.queries()) and e.oracle_sql()"
    (tmp_path / "tidemark/llm/__pycache__").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=120).returncode == 0


def test_files_of_generations_and_pointers(spark):
    text = '[[entry]]\ngeneration = 1\ncode_hash = "00"\n[[entry]]\ngeneration = 2\ncode_hash = "01"\n'
    assert [r.generation for r in lineage.lineage(spark, text, b"p").collect()] == [2, 1]
    with pytest.raises(ValueError):
        lineage.pointer_records(spark, "")


def test_content_regions():
    long = "words " * 20
    assert html.content_of(f"<body><nav>menu</nav><article>{long}</article></body>") == long.strip()
    assert html.content_of(f"<main>short</main><div id=content>{long}</div>") == long.strip()
    assert html.content_of("<body><p>a</p><script>x</script>b</body>") == "a\nb" and html.content_of("<p>a</p>", strict=True) == ""
    assert html.Page('<a href="/x">y</a><a>z</a>').links == ["/x"]


def test_frequent_keys_are_judged_as_rare_ones_are(monkeypatch):
    """Many rows of one key, a few of another, forgeries in between; the first key's windows are wide, and seeds aren't reckoned anew for each row."""
    often, rare = b"\1" * 32, b"\3" * 32
    seeds = [rare if i % 90 == 0 else often for i in range(codec.OFTEN + 60)]
    rows = [(codec.public_key(s), b"m%d" % i, codec.sign(s, b"m%d" % (i + (i % 7 == 0)))) for i, s in enumerate(seeds)]
    made, plain = [], codec._windows
    monkeypatch.setattr(codec, "_windows", lambda p, bits: made.append(bits) or plain(p, bits))
    codec._wide_windows.cache_clear(), codec._key_windows.cache_clear()
    got = codec.verify_all(*map(list, zip(*rows)))
    assert got == [i % 7 != 0 for i in range(len(rows))] == [codec.verify(*r) for r in rows]
    assert codec.WIDE in made and codec.NARROW in made


def test_references_without_a_semicolon_are_read():
    """As a browser reads them, in a title that was cut as well as at the end of a page."""
    long = "words " * 20
    assert html.content_of(f"<article><h1>this &amp;&amp</h1>{long}</article>") == f"this &&\n{long.strip()}"
    assert html.content_of("<body><p>R&ampD &copy") == "R&D ©"


def test_a_source_of_many_records_has_several_indexes(spark, sf_dir, monkeypatch):
    """With few records to an index, sources that hold more are still judged by their records, not refused for their size."""
    from tidemark.operators import verify_many
    from tidemark.plans import signed

    from tests.oracle import differences
    from tidemark.plans.registry import ORACLES

    monkeypatch.setattr(verify_many, "MAX_RECORDS", 4)
    monkeypatch.setattr(signed, "MAX_RECORDS", 4, raising=False)
    assert differences(spark, signed.verify_sources, ORACLES["verify_sources"], sf_dir) is None
