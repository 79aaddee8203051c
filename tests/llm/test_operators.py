"""Corpus operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tests.oracle import differences
from tidemark.llm import audio, bpe, exact_dedup, jaccard_join, langid, mixing, pii, quality, sharding, suffix_dedup
from tidemark.llm import queries as Q

#: Extra columns whose names the operators use themselves.
EXTRA = "_row size _key _chunk _finish _finishes _grade _label_id _doc_id _text _id _doc _whole _v _n _class _set target node ids _n_".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
ODD = [
    (1, "the same words stand here twice over", "en", "a", 1), (2, "the same words stand here twice over", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
    (5, "x" * 9000 + " tail", "en", "a", 0), (6, "x" * 9000 + " tail", "en", None, 0), (7, " \n\t ", "de", "a", 0), (None, "no id at all", "de", "b", 0),
    (8, "repeated row", "de", "b", 0), (8, "repeated row", "de", "b", 0), (9, "é😀 <|endoftext|> it's 12.5%", "fr", "c", 0), (8, "another text of 8", "de", "b", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *(f"{c} of {r[0]}" for c in EXTRA)) for r in ODD], SCHEMA)


def extras_kept(df):
    """Whether each row still has the values of its own clashing columns."""
    return df.columns[5:] == EXTRA and all(r[c] == f"{c} of {r.doc_id}" for r in df.collect() for c in EXTRA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_text(rows):
    return collections.Counter(rows)


def test_bpe_is_the_librarys(spark, odd, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer())
    for df in (odd, docs):
        want = []
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert by_text(map(tuple, bpe.bpe_round_trip(df, Q.tokenizer()).collect())) == by_text(want)
    again = bpe.bpe_decode(bpe.bpe_encode(odd, Q.tokenizer()), Q.tokenizer()).collect()
    assert all(r.decoded == (r.text or "") for r in again)
    few = bpe.bpe_encode(odd, Q.tokenizer(), keep=["doc_id"])
    assert few.columns == ["doc_id", "ids"]
    assert sorted((str(r.doc_id), r.ids) for r in few.collect()) == sorted((str(r.doc_id), r.ids) for r in again)


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    assert differences(spark, Q.queries()[name], Q.oracle_sql()[name], sf_dir) is None


def sql_on(sql, rows, columns="doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE TABLE documents ({columns})")
    c.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = c.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def test_exact_dedup(spark, odd, sf_dir):
    for block in (4, 8192):
        got = exact_dedup.exact_dedup(odd, block_bytes=block).collect()
        groups = collections.defaultdict(list)
        for r in ODD:
            groups[r[1] or ""].append(r[0])
        assert len(got) == len(ODD) and sum(r.kept for r in got) == len(groups)
        for r in got:
            own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            assert r.group_size == len(own) and r.keep_id == max((x for x in own if x is not None), default=None)
    kept = exact_dedup.drop_exact_copies(odd)
    assert extras_kept(kept) and kept.count() == len({r[1] or "" for r in ODD})


def test_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        plan = sharding.best_fit_decreasing(collections.Counter(sizes).items(), 50)
        bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [i for i, b in enumerate(bins) if 50 - b >= s]
            if fits:
                bins[min(fits, key=lambda i: (50 - bins[i], i))] += s
            else:
                bins.append(s)
        loads = collections.Counter()
        for size, first, end, shard in plan:
            loads[shard] += size * (end - first)
        assert sorted(loads.values()) == sorted(bins)


def test_sharding(odd, docs):
    for df in (odd, docs):
        got = sharding.pack_shards(df).collect()
        texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert texts == collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
        shards = collections.defaultdict(list)
        crcs = collections.defaultdict(set)
        for r in got:
            shards[r.shard].append(r.slot)
            crcs[r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(c) == 1 for c in crcs.values()) and set(shards) <= set(range(16))
    loads = collections.Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 0.02 * max(loads.values())


@pytest.mark.parametrize("block,broadcast_rows", [(3, 0), (1 << 16, 200_000)])
def test_sharding_packs_group_by_group(spark, monkeypatch, block, broadcast_rows):
    """Many groups of few sizes, against a plain walk over groups by size and hash, with a capacity and with a number of shards."""
    monkeypatch.setattr(sharding, "BLOCK", block)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    texts = [f"{i:03d}" + "x" * rng.choice((0, 0, 1, 5, 17, 90)) for i in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = collections.Counter()
    for _, t in rows:
        sizes[t] += len(t) + 1
    order = sorted(sizes, key=lambda t: (-sizes[t], hashlib.sha256(t.encode()).digest()))

    def packed(capacity):
        room, at = [], {}
        for t in order:
            fits = [i for i, r in enumerate(room) if r >= sizes[t]]
            if not fits:
                room.append(max(capacity, sizes[t]))
            at[t] = min(fits, key=lambda i: (room[i], i)) if fits else len(room) - 1
            room[at[t]] -= sizes[t]
        return at, len(room)

    want, _ = packed(700)
    assert {r.doc_id: r.shard for r in sharding.pack_shards(df, capacity=700).collect()} == {i: want[t] for i, t in rows}
    least = max(-(-sum(sizes.values()) // 7), max(sizes.values()))
    want = next(at for at, n in (packed(least * (1024 + more) // 1024) for more in sharding.CAPACITIES) if n <= 7)
    assert {r.doc_id: r.shard for r in sharding.pack_shards(df, 7).collect()} == {i: want[t] for i, t in rows}


def test_mixing(odd, docs):
    for df in (odd, docs):
        got = mixing.mix(df).collect()
        assert by_text(map(tuple, got)) == by_text(map(tuple, mixing.mix(df).collect()))
        words = collections.Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect())
        assert words == collections.Counter((r.doc_id, r.size) for r in got)
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    source = {r.doc_id: r.source for r in df.collect()}
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert r.target <= 3 * r.source_size + 1e-6
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1e-3
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(r.taken for r in got) <= sum(r.size for r in got)


def mix_tables():
    yield [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 20_000)] + [("a", 100)] * 100 + [("b", 100)] * 60 + [("c", 100)] * 20)]
    yield [(1, "w " * 10, "en", "a", 0)]
    yield [(i, "w " * n, "en", s, 0) for i, (s, n) in enumerate([("a", 3), ("b", 3), (None, 4)])]
    yield [(None, "same row", "en", "a", 0)] * 2500 + [(7, None, "en", "b", 0), (8, "", "en", "c", 0), (8, "one two three", "de", "b", 0)] + ODD
    yield [(1, "x y z", "en", "a", 0), (1, "x y z", "en", "b", 0), (2, "p q r s", "en", "c", 0)]
    for seed in range(8):
        rng = random.Random(seed)
        yield [(rng.randrange(9), "w " * int(rng.paretovariate(0.7)), "en", rng.choice([None, *"abcdefg"][: rng.randint(1, 8)]), 0) for _ in range(rng.randint(1, 60))]


@pytest.mark.parametrize("rows", list(mix_tables()))
def test_mixing_is_the_plain_queue(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(df)
    columns, want = sql_on(Q.oracle_sql()["op4_mixing"], rows)
    assert by_text(map(tuple, got.select(*columns).collect())) == by_text(want)
    sizes = sum(r[1] for r in want)
    assert sum(r[4] for r in want) <= sizes
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    joined = collections.Counter((r.doc_id, r.source) for r in mixing.mixed_documents(df).collect())
    for r in mixing.mix_positions(df, "doc_id", "text", "source", None, 3, 17).select("_id", "_key", "size", "target", F.size("_finishes").alias("n")).join(df.select("source", mixing.identity(df).alias("_key")).distinct(), "_key").collect():
        taken[r.source] += r.n * r["size"]
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        joined[r._id, r.source] -= r.n
    assert not any(joined.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_the_mix_keeps_whole_rows(odd):
    assert extras_kept(mixing.mixed_documents(odd).where("doc_id is not null"))


def test_reshare():
    got = mixing.reshare({"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 2, None: 3}, 1015, 3)
    assert got == {"a": 30.0, "b": 970.0, None: 15.0}


def test_quality_on_held_out(spark, docs, sf_dir):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit_quality(d, labels, held_out=True)
    assert model.thresholds[0] < model.thresholds[1]
    score = {r.doc_id: r for r in quality.score_quality(d, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good = [score[r.doc_id].kept for r in held if r.quality == 1 and not r.toxic]
    bad = [score[r.doc_id].kept for r in held if r.quality == 0 or r.toxic]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.25


def test_quality_with_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.classify_quality(odd, labels).count() == len(ODD)
    kept = quality.keep_good(odd, labels.limit(0))
    assert extras_kept(kept.where("doc_id is not null")) and kept.columns == odd.columns
    assert quality.classify_quality(odd.limit(0), labels).count() == 0


def test_ordinal_slopes_and_scores():
    import numpy as np

    rng = np.random.default_rng(3)
    docs = [rng.choice(12, rng.integers(0, 6), replace=False).astype(np.int32) for _ in range(40)]
    grades, share = rng.integers(0, 3, 40), rng.random(40)
    flat, row = np.concatenate(docs), np.repeat(np.arange(40), [len(d) for d in docs])
    w, t = rng.normal(size=12), np.array([-0.7, 0.4])

    def plain(w, t):
        total = 0.0
        for d, g, s in zip(docs, grades, share, strict=True):
            above = [1.0, *(1 / (1 + np.exp(x - sum(w[k] for k in d))) for x in t), 0.0]
            total += s * np.log(above[g] - above[g + 1])
        return total

    value, by_w, by_t = quality.OrdinalModel.slopes(w, t, flat, row, grades, share)
    assert abs(value - plain(w, t)) < 1e-9
    for k in range(12):
        e = np.eye(12)[k] * 1e-5
        assert abs((plain(w + e, t) - plain(w - e, t)) / 2e-5 - by_w[k]) < 1e-6
    for k in range(2):
        e = np.eye(2)[k] * 1e-5
        assert abs((plain(w, t + e) - plain(w, t - e)) / 2e-5 - by_t[k]) < 1e-6
    model = quality.OrdinalModel(w, t)
    for d in docs:
        assert np.allclose(model.tails(d), [1 / (1 + np.exp(x - sum(w[k] for k in d))) for x in t])


def test_scores_are_the_models(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    features = quality.Features()
    want = {r.doc_id: model.tails(features.of(r.text or "")) for r in docs.collect()}
    for r in quality.score_quality(docs, model).collect():
        a, b = want[r.doc_id]
        assert r.expected_grade == a + b and r.p_good == b and r.kept == (b >= 0.5)


def brute_removed(rows):
    seen, out = set(), []
    text_hash = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  Spark's, unsigned
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    for i, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1])), hashlib.sha256(rest).hexdigest()))
    return by_text(out)


@pytest.mark.parametrize("hot,group_bytes", [(16384, 4 << 20), (2, 4 << 20), (2, 500), (0, 500)])
def test_suffix_dedup(spark, odd, docs, hot, group_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)  # only the driver reads it
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(2000))
    rows = []
    for i in range(60):
        a = rng.randrange(1800)
        rows.append((i, rng.choice(["", "xyz" * rng.randint(0, 50)]) + base[a : a + rng.randint(1, 300)] + "q" * rng.randint(0, 130)))
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd, docs if group_bytes > 500 else odd):
        got = by_text(map(tuple, suffix_dedup.dedup_substrings(df, hot_places=hot).collect()))
        assert got == brute_removed([(r.doc_id, r.text) for r in df.collect()])


def test_an_anchor_of_100000_places(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    phrase = "a common phrase of words"
    rows = [(i if i % 3 else None, "".join(phrase + "".join(rng.choices(letters, k=16)) for _ in range(10))) for i in range(10_000)]
    rows += [(20_000 + i, rows[i * 7][1][5 : 5 + rng.randint(100, 300)]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup_substrings(df)
    assert by_text(map(tuple, got.collect())) == brute_removed(rows)


def test_documents_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None, f"{i} " * 2000) for i in range(200)], "doc_id long, text string")
    plan = suffix_dedup.dedup_substrings(df)
    assert plan.count() == 200 and suffix_dedup.task_count(10, 4) == 8 and suffix_dedup.task_count(10_000, 4) == 2500


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    import numpy as np

    rows = np.random.default_rng(1).integers(0, 2, (300, 20)).astype(np.uint8)
    want = sorted(map(bytes, rows))
    for base in (suffix_dedup.BASES[0], np.uint64(0)):  # a base of 0 hashes the last byte alone
        monkeypatch.setattr(suffix_dedup, "BASES", (base, base))
        order, shared = suffix_dedup.HashedSuffixes(rows).sorted()
        assert [bytes(rows[i]) for i in order] == want
        assert all(rows[order[i], : shared[i]].tolist() == rows[order[i - 1], : shared[i]].tolist() for i in range(1, 300))


PII = [
    "write to a.b+c@mail.example.com, or x@@y.z@w.org!", "1.2.3.4.5.6.7.8 300.1.1.1 01.02.03.004", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (555) 123-4567 or +12", "no data", "@", "a@b a@b.c",
    "1" * 4000 + ".1.1.1", "a" * 20000, "+" * 300 + "1234567890", "9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9 9", "é a@é.com b@c.de😀",
]


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_personal_data(spark, odd, docs):
    rng = random.Random(2)
    texts = PII + ["".join(rng.choice("a1.@+- ()") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [r.text for r in docs.collect()]
    for t in texts:
        if len(t) < 19000:
            assert pii.base_spans(t) == brute_spans(t), t
    got = pii.find_personal_data(odd)
    assert got.count() == len(ODD)
    assert pii.sanitised("mail a@b.cd now", "email:5:11") == "mail [EMAIL] now"


def test_revealing_terms(spark):
    filler = ["plain words of no weight number" for _ in range(60)]
    told = [f"{a} the zanzibar office answers bob@corp.example.com {b}" for a, b in (("today", "again"), ("monday", "later"), ("first", "surely"), ("maybe", "never"))]
    copies = ["unrelated quokka sentence with amy@corp.example.com inside"] * 5
    df = spark.createDataFrame(list(enumerate(filler + told + copies)), "doc_id long, text string")
    rows = pii.find_personal_data(df).collect()
    found = {r.doc_id: r.spans for r in rows}
    assert "term:" in found[60] and all("term" in found[i] for i in range(64, 69)) and not found[0]
    text = told[0]
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[60].split(",")) if k == "term"]
    assert "zanzibar" in terms


def test_revealing_terms_of_whole_documents(spark):
    far = "plain words of no weight number " * 10
    rows = ["plain words of no weight number"] * 2000
    rows += [f"Okapi stands {far}amy@corp.example.com {far}with the okapi", f"shared zebra bob@corp.example.com {far}", f"shared zebra {far}"]
    rows += [f"zebra number {far}"] * 3
    found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = sql_on(Q.oracle_sql()["op7_pii"], [(i, t, None, None, None) for i, t in enumerate(rows)])
    assert found == {r[0]: r[-1] for r in want[1]}
    terms = {i: [rows[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in found[i].split(",") if x) if k == "term"] for i in found}
    assert terms[2000] == ["Okapi", "stands", "with", "okapi"]
    assert not any(terms[i] for i in terms if i != 2000)


def test_terms_dont_depend_on_the_size_of_the_corpus(spark):
    """The same documents among few and many others have the same terms: those that stand nowhere else."""
    told = ["the zanzibar office answers bob@corp.example.com today", "shared words of amy@corp.example.com here", "shared words again"]
    for n in (1, 40, 1500):
        rows = [*told, *["plain today here again of no weight"] * n]
        found = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
        terms = {i: {rows[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in found[i].split(",") if x) if k == "term"} for i in found}
        assert terms[0] == {"zanzibar", "office", "answers"} and not any(terms[i] for i in terms if i != 0)


def test_a_document_of_many_entities_and_terms(spark):
    """Entities and terms of the same documents are judged as one class, not as pairs."""
    import time

    letters = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    text = " ".join(f"{letters(i)}@mail.example.com {letters(i)}word" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 2]), (3, "nothing")], "doc_id long, text string")
    began = time.monotonic()
    found = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert found[1].n_email == 20_000 and found[1].spans.count("term:") > 9_000 and time.monotonic() - began < 90


def test_mixed_rows_with_nested_columns(spark):
    """Rows that differ in nested nulls alone are different rows."""
    df = spark.sql("""select 1L as doc_id, 'two words' as text, 'a' as source, array(cast(null as string)) as x, named_struct('p', cast(null as string)) as y, map('k', cast(null as string)) as z
        union all select 1L, 'two words', 'a', array('null'), named_struct('p', 'null'), map('k', 'null') union all select 1L, 'two words', 'a', array('NULL'), named_struct('p', ''), map('k', '')""")
    assert sorted(str(r.x) for r in mixing.mixed_documents(df).collect()) == sorted(str(r.x) for r in df.collect())
    from tidemark.llm.common import identity

    assert df.select(identity(df)).distinct().count() == 3


def test_names_with_backticks_and_ids_that_cant_be_ordered(spark):
    df = spark.createDataFrame([(1, "some text")], "`a``b` long, `t``x` string")
    row = bpe.bpe_encode(df, Q.tokenizer(), text_col="t`x").first()
    assert row["a`b"] == 1 and len(row["ids"]) == 2
    assert bpe.bpe_round_trip(df, Q.tokenizer(), "a`b", "t`x").first()["n_tokens"] == 2
    with pytest.raises(ValueError):
        suffix_dedup.dedup_substrings(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_audio(spark, odd, docs):
    for df in (odd, docs):
        for r, t in zip(sorted(audio.audio_digest(df).collect(), key=lambda r: (r.doc_id or -1, r.payload_sha256)), sorted(df.collect(), key=lambda r: (r.doc_id or -1, hashlib.sha256(audio.padded((r.text or "").encode())).hexdigest())), strict=True):
            payload = audio.padded((t.text or "").encode())
            assert (r.n_bytes, r.payload_bytes) == (len((t.text or "").encode()), len(payload)) and len(payload) % 64 == 0 and payload
            assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == 44 + len(payload)
    row = audio.audio_columns(odd).where("doc_id = 5").first()
    table = pa.ipc.open_stream(bytes(row.features)).read_all()
    assert table.schema.field("log_mel").type.shape == [64, 40] and table.column("end_ms")[-1].as_py() > 0
    assert audio.from_wav(bytes(row.media))[0] == audio.padded(("x" * 9000 + " tail").encode())


def test_resampling_keeps_a_tone():
    import numpy as np

    t = np.arange(16000) / 16000
    y = audio.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32), 1, 2)
    assert len(y) == 8000 and np.argmax(np.abs(np.fft.rfft(y))) == 500
    assert len(audio.resample(y, 3, 2)) == 12000 and np.argmax(np.abs(np.fft.rfft(audio.resample(y, 3, 2)))) == 500
    assert audio.segments(np.array([0, 0, 9, 9, 5, 5, 0, 0], np.float32)) == [(2, 6)]


def test_audio_features_are_their_definitions():
    """Resampling, mel energies and segments computed one number at a time."""
    import cmath
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=700).astype(np.float32)
    x[250:450] *= 9
    for up, down in ((1, 2), (3, 2)):
        h = audio.low_pass(up, down)
        lag = len(h) // up // 2
        want = [sum(float(h[t]) * float(x[(m * down - t) // up + lag]) for t in range(len(h)) if (m * down - t) % up == 0 and 0 <= (m * down - t) // up + lag < len(x)) for m in range(-(-len(x) * up // down))]
        assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)
    rate = 8000
    mels, energy = audio.log_mel(x, rate)
    assert len(mels) == 1 + (700 - audio.FRAME) // audio.HOP
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    for n in (0, 3, len(mels) - 1):
        frame = [float(x[n * audio.HOP + i]) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1))) for i in range(audio.FRAME)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / audio.FFT) for i, v in enumerate(frame))) ** 2 for k in range(audio.FFT // 2 + 1)]
        assert abs(energy[n] - 10 * math.log10(sum(v * v for v in frame) / audio.FRAME)) < 1e-3
        for m in range(audio.MELS):
            low, mid, high = edges[m : m + 3]
            total = sum(p * max(0.0, min((k * rate / audio.FFT - low) / (mid - low), (high - k * rate / audio.FFT) / (high - mid))) for k, p in enumerate(power))
            assert abs(mels[n, m] - math.log10(max(total, 1e-10))) < 1e-3
    mean, deviation, on, want = energy.mean(), energy.std(), False, []
    for i, e in enumerate(energy):
        if not on and e > mean + 0.5 * deviation:
            on, start = True, i
        elif on and e < mean - 0.5 * deviation:
            on = False
            want.append((start, i))
    assert audio.segments(energy) == want + [(start, len(energy))] * on and want
    table = audio.audio_features(audio.to_wav(audio.padded(bytes(rng.integers(0, 256, 20_000).tolist()))))
    assert audio.described(pa.ipc.open_stream(audio.as_ipc(table)).read_all()) == audio.described(table)


def test_language_on_held_out(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.collect()}
    held = [r for r in langid.identify_language(d).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in held)
    both = {lang: [r.text for r in d.where(~langid.is_held_out("doc_id")).collect() if r.lang == lang and 0 < len(r.text.encode()) <= langid.DICTIONARY_BYTES] for lang in sorted(set(truth.values()))}
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    plain = {lang: langid.dictionary(sorted(set(texts), key=signed)[: langid.SAMPLE_DOCS]) for lang, texts in both.items()}
    assert langid.learn_dictionaries(d) == plain
    for r in d.limit(60).collect():
        sizes = {}
        for lang, data in plain.items():
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_dict_id=False).compress(r.text.lower().encode()))
        first, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert langid.Compressors(plain).predict(r.text)[:2] == (first[1], (second[0] - first[0]) / second[0])
    assert [langid.Compressors(plain).predict(t)[0] for t in ("² ½ Ⅷ 12", "_", "")] == ["und"] * 3
    rows = langid.identify_language(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (3, 4, 7)} == {"und"}


def brute_classes(rows):
    words = jaccard_join.Words()
    sets = [set(jaccard_join.shingles(t or "", words).tolist()) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        if n is not None:
            least[find(i)] = min(least.get(find(i), n), n)
    return by_text((n, least.get(find(i)), links[i]) for i, (n, _) in enumerate(rows))


@pytest.mark.parametrize("small,block,size", [(256, 2048, 32 << 20), (4, 8, 32 << 20), (4, 2048, 3000)])
def test_jaccard_join(spark, odd, docs, small, block, size, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", size)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i, k in enumerate(rng.randrange(120) for _ in range(40))]
    often = rows + [rows[0]] * 50 + [(None, rows[1][1])] * 30
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(often, "doc_id long, text string"), odd, docs if small > 4 else odd):
        got = by_text((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect())
        assert got == brute_classes([(r.doc_id, r.text) for r in df.collect()])
    assert extras_kept(jaccard_join.keep_one_of_each(odd))


def test_recall_of_ids_divisible_by_50(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    words, holders, sets = jaccard_join.Words(), collections.defaultdict(list), {}
    for r in df.collect():
        sets[r.doc_id] = jaccard_join.shingles(r.text or "", words).tolist()
        for x in sets[r.doc_id]:
            holders[x].append(r.doc_id)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(df).collect()}
    want = 0
    for i in sets:
        if i % 50 == 0:
            both = collections.Counter(j for x in sets[i] for j in holders[x])
            links = [j for j, n in both.items() if j != i and 9 * n >= 4 * (len(sets[i]) + len(sets[j]))]
            want += len(links)
            assert got[i].n_links == len(links) and all(got[j].class_id == got[i].class_id for j in links)
    assert want > 50


def test_slots_of_a_large_cluster_are_bounded(spark):
    n = 50_000
    found = spark.range(n + 1000).select(F.when(F.col("id") < n, 7).otherwise(F.col("id")).alias("path"), F.col("id").alias("node"), F.when(F.col("id") < n, n).otherwise(1).alias("n"), F.lit(2000).alias("_bytes"))
    many = jaccard_join.parts("n")
    slots = jaccard_join.slot_count(found, many, "_bytes")
    rows = jaccard_join.in_slots(jaccard_join.in_blocks(found, "path", "node", many), "path", slots).groupBy("_slot").count()
    pairs = jaccard_join.in_blocks(found, "path", "node", many).where("path = 7").groupBy("_i", "_j").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    blocks = -(-n // jaccard_join.BLOCK)
    assert pairs.n == blocks * (blocks + 1) // 2 and pairs.most <= 2.2 * jaccard_join.BLOCK
    assert rows.agg(F.max("count")).first()[0] < 8 * jaccard_join.NODES_A_SLOT


def test_links_are_counted_exactly():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 9000).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: rng.integers(1, 9000)], rng.integers(0, 1 << 60, rng.integers(0, 900)).astype(np.uint64)))) for _ in range(40)]
    side = rng.integers(0, 2, 40)
    alike = {(i, j) for i in range(40) for j in range(40) if i != j and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert {(i, j) for i, j in alike if i < j} == set(zip(*(x.tolist() for x in jaccard_join.linked(sets, side, True, 0.8)), strict=True))
    assert {(i, j) for i, j in alike if side[i] < side[j]} == set(zip(*(x.tolist() for x in jaccard_join.linked(sets, side, False, 0.8)), strict=True))


@pytest.mark.parametrize("name", Q.queries())
def test_empty_tables(spark, odd, name, monkeypatch):
    others = {"labels": "doc_id long, quality int, toxic int", "stamps": "stamp_id long, source string, zone string, raw string"}
    monkeypatch.setattr(Q, "table", lambda spark, sf_dir, name: spark.createDataFrame([], others[name]) if name in others else odd.limit(0))
    assert Q.queries()[name](spark, "").count() == 0


#: Of those without a row for each document test_new_operators has long texts.
@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in ("op11_spelling", "op12_stamps")])
def test_very_long_texts(spark, sf_dir, name, monkeypatch):
    """Two near copies of 3 MB, one without white space, among short texts."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=460_000))
    rows = [(1, long, "en", "a", 0), (2, long + " tail", "en", "b", 0), (3, "z" * 3_000_000, "en", "a", 0), (4, "short words of a text", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    real = Q.table
    monkeypatch.setattr(Q, "table", lambda spark, sf_dir, name: real(spark, sf_dir, name) if name == "labels" else df)
    got = {r.doc_id: r for r in Q.queries()[name](spark, sf_dir).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    if name == "op6_suffix_dedup":
        assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (0, len(long), 2_999_999)
    if name == "op10_jaccard_join":
        assert [(got[i].class_id, got[i].n_links) for i in (1, 2, 3, 4)] == [(1, 1), (1, 1), (3, 0), (4, 0)]
    if name == "op2_exact_dedup":
        assert all(r.kept and r.text_sha256 == hashlib.sha256(rows[r.doc_id - 1][1].encode()).hexdigest() for r in got.values())


def test_tokenizer_files_of_other_kinds_are_refused(tmp_path):
    import json

    spec = json.load(open(Q.tokenizer(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        with pytest.raises(ValueError):
            bpe.check_kind(spec | change)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames = [docs]
    for _, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
    good, exact, near, mixed, coded = frames[1:]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert exact.select("text").distinct().count() == exact.count() == good.select("text").distinct().count()
    texts = {r.text: r.doc_id for r in good.orderBy("doc_id").collect()}
    assert {(r.doc_id, r.text) for r in exact.collect()} == {(i, t) for t, i in texts.items()}
    classes = {c for (_, c, _), n in brute_classes([(r.doc_id, r.text) for r in exact.collect()]).items()}
    assert {r.doc_id for r in near.collect()} == classes
    times = collections.Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(near).collect() if r.taken}
    assert times == want
    assert collections.Counter(r.doc_id for r in coded.collect()) == times
    assert P.run(spark, sf_dir).count() == coded.count()


def test_the_pipelines_stages_take_odd_and_empty_tables(spark, odd, sf_dir, monkeypatch):
    import corpus_pipeline as P

    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (plain, plain.limit(0)):
        for _, stage in P.STAGES:
            assert stage(spark, df, sf_dir).count() <= 3 * len(ODD)
