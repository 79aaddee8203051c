"""Indexes, ranking signals and feedback: laws, plain versions, convergence, restarts, odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import collections as lists
from tidemark.operators import diversity, feedback, keyword_index, trust, vector_index

TEXTS = [(1, "the cat sat on the mat the cat"), (2, "The CAT, again!"), (3, None), (4, ""), (5, "dog " * 300 + "cat"), (6, "élan vital the end")]
DOCS = "doc_id long, text string"


def state_of(index):
    return sorted((r.term, r.doc, r.tf, r.len, tuple(r.positions)) for r in index.postings().collect())


def test_deltas_amount_to_the_whole(spark, tmp_path):
    """Segments, masks and merged segments after many deltas hold what one index of the last texts does; so does the folder when it is opened again."""
    rng = random.Random(2)
    words = "red green blue cat dog über".split()
    index, now = keyword_index.create(spark, str(tmp_path / "a")), {}
    for n in range(7):
        delta = {rng.randrange(8): rng.choice([None, " ".join(rng.choices(words, k=rng.randrange(6)))]) for _ in range(4)}
        gone = {d for d in delta if rng.random() < 0.3}
        now = {d: t for d, t in (now | delta).items() if d not in gone}
        rows = [(d, t, d in gone) for d, t in delta.items()]
        index = keyword_index.apply_delta(index, spark.createDataFrame(rows, f"{DOCS}, is_tomb boolean"), fan=3)
        assert len(index.segments) < 3 * 4
    whole = keyword_index.build(spark.createDataFrame(sorted(now.items()), DOCS), str(tmp_path / "b"))
    again = keyword_index.open_index(spark, str(tmp_path / "a"))
    assert state_of(index) == state_of(whole) == state_of(again)
    assert (index.live, index.total_len) == (whole.live, whole.total_len) == (again.live, again.total_len) == (len(now), sum(len((t or "").split()) for t in now.values()))
    assert keyword_index.open_index(spark, str(tmp_path / "none")).segments == ()


def test_search_and_phrases(spark, tmp_path):
    index = keyword_index.build(spark.createDataFrame(TEXTS, DOCS), str(tmp_path / "a"))
    found = keyword_index.search_text(index, "cat the unknown", 10).orderBy("rn").collect()
    n, mean = 6, index.total_len / 6

    def score(doc):
        terms = [t.strip(",!").lower() for t in (dict(TEXTS)[doc] or "").split()]
        df = {t: sum(t in [x.strip(",!").lower() for x in (text or "").split()] for _, text in TEXTS) for t in ("cat", "the")}
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * terms.count(t) * 2.2 / (terms.count(t) + 1.2 * (0.25 + 0.75 * len(terms) / mean)) for t in df)

    assert {r.doc: pytest.approx(r.score, abs=1e-8) for r in found} == {d: score(d) for d in (1, 2, 5, 6)}
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True) and [r.rn for r in found] == [1, 2, 3, 4]
    assert keyword_index.search_text(index, "", 3).count() == keyword_index.search_text(index, "nowhere", 3).count() == 0
    asked = spark.createDataFrame([("a", "the cat"), ("b", "the the"), ("c", "Dog dog dog"), ("d", "nowhere cat"), ("e", ""), ("f", "cat sat on the mat the cat")], "query string, text string")
    got = sorted((r.query, r.doc, r.place) for r in keyword_index.phrases(index, asked).collect())
    assert got == sorted([("a", 1, 0), ("a", 1, 6), ("a", 2, 0), ("f", 1, 1), *(("c", 5, i) for i in range(298))])


def test_a_query_reads_its_terms_alone(spark, tmp_path):
    index = keyword_index.build(spark.createDataFrame(TEXTS, DOCS), str(tmp_path / "a"))
    plan = index.postings(["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,cat)]" in plan or "In(term, [cat])" in plan


def test_an_index_is_built_without_dealing_postings(spark):
    """A document's postings are made where its text is: no shuffle, and no list that is gathered over rows."""
    docs = spark.createDataFrame([*TEXTS, (7, "zz aa zz  bb_aa 1 zz")], DOCS)
    found = keyword_index.postings_of(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "collect_list" not in plan
    assert sorted((r.term, r.tf, r.len, tuple(r.positions)) for r in found.where("doc = 7").collect()) == [("1", 1, 7, (5,)), ("aa", 2, 7, (1, 4)), ("bb", 1, 7, (3,)), ("zz", 3, 7, (0, 2, 6))]
    assert {r.doc for r in found.collect()} == {1, 2, 5, 6, 7}


def test_a_phrase_starts_from_its_rarest_term(spark, tmp_path):
    """Postings of frequent terms meet only the documents that a query's rarest term leaves, and are found there all the same."""
    rows = [(n, "the cat and the dog" + (" of the old mill the end" if n % 40 == 7 else "")) for n in range(120)]
    index = keyword_index.build(spark.createDataFrame(rows, DOCS), str(tmp_path / "a"))
    asked = spark.createDataFrame([("a", "the old mill the"), ("b", "mill the unknown"), ("c", "the dog")], "query string, text string")
    found = keyword_index.phrases(index, asked)
    assert sorted((r.query, r.doc, r.place) for r in found.collect()) == sorted([*(("a", n, 6) for n in (7, 47, 87)), *(("c", n, 3) for n in range(120))])
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert any("doc#" in x and "term#" in x for x in joins)  # by term and document, not by term alone


def test_changes_meet_their_texts_once(spark, sf_dir, monkeypatch):
    """Texts are looked up once for all generations, and versions that lose don't carry any."""
    from tidemark.plans import discovery

    asked, plain = [], discovery.with_texts
    monkeypatch.setattr(discovery, "with_texts", lambda spark, sf_dir, versions: asked.append(versions.columns) or plain(spark, sf_dir, versions))
    assert discovery.index_deltas(spark, sf_dir).count() > 0
    assert len(asked) == 1 and "text" not in asked[0]


def test_vector_search(spark, sf_dir):
    """Recall of the probing search against the exact one; odd vectors take no part; many equal ones are many blocks."""
    from tidemark.plans import discovery

    found = {(r.query, r.id) for r in discovery.vector_search(spark, sf_dir).collect()}
    exact = {(r.query, r.id) for r in discovery.vector_exact(spark, sf_dir).collect()}
    assert len(exact) and len(found & exact) >= 0.9 * len(exact)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(400, [1.0, 2.0, 4.0]), (401, None), (402, [1.0, None, 2.0]), (403, [float("nan"), 1.0, 1.0]), (404, [])]
    sound = vector_index.usable(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    quantiser = vector_index.fit(sound)
    got = vector_index.nearest(vector_index.encode(sound, quantiser), sound.where("id in (5, 400)"), quantiser, k=3, probes=99, block=50).collect()
    assert sorted((r.query, r.rn, r.id, r.distance) for r in got) == [(5, 1, 0, 0.0), (5, 2, 1, 0.0), (5, 3, 2, 0.0), (400, 1, 0, 1.0), (400, 2, 1, 1.0), (400, 3, 2, 1.0)]
    with pytest.raises(ValueError):
        vector_index.fit(sound.limit(0))


def plain_picks(items, k, balance):
    left, picked = {i: (r, np.array(v, float)) for i, r, v in items}, []
    while left and len(picked) < k:
        def score(i):
            like = [float(left[i][1] @ v) / (np.linalg.norm(left[i][1]) * np.linalg.norm(v)) for _, _, v in picked]
            return round(balance * left[i][0] - (1 - balance) * max([0.0, *like]), 9)

        best = max(left, key=lambda i: (score(i), -i))
        picked.append((best, score(best), left.pop(best)[1]))
    return [(i, pytest.approx(s, abs=1e-8)) for i, s, _ in picked]


@pytest.mark.parametrize("pool", [4, 12, 2000])
def test_diverse_picks_are_the_plain_ones(spark, pool):
    """The same whether a group is gathered, settled by its pool, or picked round by round."""
    rng = random.Random(8)
    items = {g: [(i, rng.choice([0.2, 0.5, rng.random()]), [rng.gauss(0, 1) for _ in range(5)]) for i in range(n)] for g, n in (("a", 30), ("b", 3), ("c", 13))}
    rows = [(g, i, r, v) for g in items for i, r, v in items[g]] + [("a", 99, None, [1.0] * 5), ("a", 98, 1.0, None), (None, 1, 1.0, [1.0] * 5)]
    got = diversity.diverse(spark.createDataFrame(rows, "g string, id long, relevance double, vector array<double>"), "g", 6, 0.6, pool)
    for g in items:
        assert [(r.id, r.score) for r in got.where(f"g = '{g}'").orderBy("rn").collect()] == plain_picks(items[g], 6, 0.6), g


def test_strengths_converge_to_the_likeliest(spark):
    """Steps are the plain ones, and end once they move little; there each item's wins are nearly those that its strength makes expect."""
    games = [("a", "b", 8), ("b", "a", 2), ("b", "c", 5), ("c", "b", 5), ("a", "c", 3), ("d", "d", 9), (None, "a", 4)]
    df = spark.createDataFrame(games, "winner string, loser string, n long")
    sound = [(w, x, n) for w, x, n in games if w and w != x]
    wins = {i: sum(n for w, _, n in sound if w == i) for i in "abc"}
    load = lambda p, i: sum(n / (p[w] + p[x]) for w, x, n in sound if i in (w, x))
    plain = [dict.fromkeys("abc", 1.0)]
    for _ in range(3000):
        plain.append({i: (wins[i] + 1) / (load(plain[-1], i) + 2 / (plain[-1][i] + 1)) for i in "abc"})
    got = {r.item: r for r in feedback.strengths(df, steps=3).collect()}
    assert {i: r.strength for i, r in got.items()} == pytest.approx(plain[3]) and got["a"].wins == 11 and got["a"].met == 13
    end = {r.item: r.strength for r in feedback.strengths(df, tolerance=0.01).collect()}
    assert end in [pytest.approx(p) for p in plain[4:30]] and end == pytest.approx(plain[-1], rel=0.1) and end["a"] > end["b"]
    for i in "abc":
        p = plain[-1]
        assert wins[i] + 1 == pytest.approx(p[i] * load(p, i) + 2 * p[i] / (p[i] + 1), abs=1e-6)


def test_grades_and_reliability(spark):
    """The objective never falls; careless raters don't outvote careful ones; nulls and other grades don't count."""
    rng = random.Random(4)
    truth = {i: i % 3 for i in range(40)}
    rated = [(f"good{r}", i, t if rng.random() < 0.9 else rng.randrange(3)) for r in range(3) for i, t in truth.items()] + [(f"bad{r}", i, rng.randrange(3)) for r in range(4) for i in truth]
    rows = [*rated, (None, 1, 1), ("good0", None, 1), ("good0", 1, 7), ("good0", 1, None)]
    items, raters, objective = feedback.graded(spark.createDataFrame(rows, "rater string, item long, grade int"), 3, steps=5)
    assert all(b >= a - 1e-9 for a, b in itertools.pairwise(objective))
    found = {r.item: r for r in items.collect()}
    assert sum(found[i].grade == t for i, t in truth.items()) >= 36 and all(abs(sum(r.p) - 1) < 1e-9 and r.ratings == 7 for r in found.values())
    right = {r.rater: 0.0 for r in raters.collect()}
    for r in raters.collect():
        right[r.rater] += r.p[r.given] / 3
    assert min(right[f"good{i}"] for i in range(3)) > max(right[f"bad{i}"] for i in range(4))


@pytest.mark.parametrize("part", [2, 50_000])
def test_trust_is_the_matrixs(spark, part):
    """Steps are those of the plain matrix, however hot nodes are cut; trust sums to one; nodes that point nowhere hand it back."""
    edges = [("hub", f"n{i}", i + 1.0) for i in range(7)] + [("n1", "hub", 2.0), ("n2", "n1", 1.0), ("n2", "n1", 1.0), ("n3", None, 1.0), ("n4", "n5", 0.0)]
    got = {r.node: r.trust for r in trust.propagate(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame([("hub", 3.0), ("alone", 1.0)], "node string, share double"), 6, tolerance=0.0, part=part).collect()}
    names = sorted(got)
    seed = np.array([{"hub": 0.75, "alone": 0.25}.get(n, 0.0) for n in names])
    m = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        if b and w:
            m[names.index(b), names.index(a)] += w
    out = m.sum(0)
    x = seed
    for _ in range(6):
        x = 0.15 * seed + 0.85 * ((m / np.where(out > 0, out, 1)) @ x + x[out == 0].sum() * seed)
    assert [got[n] for n in names] == pytest.approx(list(x), abs=1e-9) and sum(got.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        trust.propagate(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame([], "node string, share double"))


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(e.totalShuffleWrite() for e in (lambda found: (found.apply(i) for i in range(found.size())))(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_trust_moves_no_edges_in_a_step(spark):
    """Edges are dealt once: what further steps shuffle is trust of nodes, less than a byte for each edge and step."""
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(40_000)})
    edges, seeds = spark.createDataFrame([(a, b, 1.0 + a % 3) for a, b in pairs], "source long, target long, weight double"), spark.createDataFrame([(7, 1.0)], "node long, share double")
    took = []
    for steps in (1, 5):
        before = shuffled(spark)
        trust.propagate(edges, seeds, steps, tolerance=0.0)
        took.append(shuffled(spark) - before)
    assert took[1] - took[0] < 4 * len(pairs)


def test_trust_is_the_same_by_any_blocks(spark):
    """However many blocks nodes are in and rows a block's edges; settings of the session are left as they were; without edges all stays with the seeds."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(30, 60), rng.random()) for _ in range(400)] + [(3, n, 1.0) for n in range(60)], "source long, target long, weight double")
    seeds, names = spark.createDataFrame([(n, 1.0) for n in range(0, 70, 9)], "node long, share double"), ["spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    found = [{r.node: r.trust for r in trust.propagate(edges, seeds, 4, tolerance=0.0, **how).collect()} for how in ({}, {"block": 7, "part": 11})]
    assert found[0] == pytest.approx(found[1], abs=1e-12) and sum(found[0].values()) == pytest.approx(1)
    assert [spark.conf.get(n) for n in names] == before
    assert {r.node: r.trust for r in trust.propagate(edges.limit(0), seeds, 2).collect()} == pytest.approx({n: 1 / 8 for n in range(0, 70, 9)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=60))
def test_there_is_always_a_place_between(cuts):
    keys = []
    for c in cuts:
        at = c % (len(keys) + 1)
        keys.insert(at, lists.between(keys[at - 1] if at else None, keys[at] if at < len(keys) else None))
    assert keys == sorted(set(keys)) and all(len(k) <= len(cuts) // 3 + 4 for k in keys)
    assert (spread := lists.spread_positions(len(cuts))) == sorted(set(spread))


def test_lists_merge_in_any_order(spark):
    """Merging commutes, associates and is idempotent; a removal takes what its curator had seen, so an element that is added again stays."""
    add = lambda *rows: lists.added(spark.createDataFrame(rows, "collection long, tag string, item string, version long, curator string, position string"))
    move = lambda *rows: lists.moved(spark.createDataFrame(rows, "collection long, tag string, version long, curator string, position string"))
    first = add((1, "t1", "apple", 1, "x", "V"), (1, "t2", "pear", 2, "x", "k"), (2, "t9", "fig", 1, "x", "V"))
    a = lists.merge(first, lists.remove_item(first, 1, "apple"))
    b = lists.merge(first, add((1, "t3", "apple", 3, "y", "g")), move((1, "t2", 4, "y", "1"), (1, "t9", 9, "y", "1")))
    c = lists.merge(first, move((1, "t2", 4, "z", "z"), (1, "t1", 8, "z", "z")))
    rows = lambda s: sorted(map(str, s.collect()))
    want = rows(lists.merge(a, b, c))
    for x, y, z in itertools.permutations((a, b, c)):
        assert rows(lists.merge(x, lists.merge(y, z))) == want
    assert rows(lists.merge(a, a)) == rows(a)
    got = [(r.collection, r.nth, r.tag, r.item) for r in lists.listed(lists.merge(a, b, c)).orderBy("collection", "nth").collect()]
    assert got == [(1, 1, "t3", "apple"), (1, 2, "t2", "pear"), (2, 1, "t9", "fig")]


def test_freshness_and_novelty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0,), (100,), (200,), (300,)], "added_at long")
    assert [r[0] for r in df.orderBy("added_at").select(diversity.freshness(F.col("added_at"), 200, 100.0)).collect()] == [0.25, 0.5, 1.0, 1.0]
    seen = spark.createDataFrame([("u", "a"), ("u", "a"), ("v", "b")], "user string, topic string")
    asked = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "a")], "user string, topic string")
    assert {(r.topic, r.novelty) for r in diversity.novelty(asked, seen, "user", "topic").collect()} == {("a", 1 / 3), ("b", 1.0)}


def test_strengths_have_partitions_by_rows(spark, sf_dir, monkeypatch):
    """More lines are more shuffle partitions while strengths are computed, and the session has its own again after."""
    from tidemark.operators import places
    from tidemark.plans import discovery

    name = "spark.sql.shuffle.partitions"
    before, during = spark.conf.get(name), []
    monkeypatch.setattr(discovery.B, "strengths", lambda *a, **k: during.append(spark.conf.get(name)) or spark.createDataFrame([], "item long, wins long, met long, strength double"))
    monkeypatch.setattr(discovery, "parts_for", lambda spark, rows: places.parts_for(spark, rows, 500))
    discovery.supplier_strengths(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert during == [str(max(int(before), 1 + lines // 500))] and int(during[0]) > int(before) and spark.conf.get(name) == before
