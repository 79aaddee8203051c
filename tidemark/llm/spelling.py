"""Operator 11: grouping of spelling variants by automata over word halves.

A word that differs from another by one inserted, deleted or replaced code point keeps one of its
halves whole: the first half at the start, or the second half at the end. So every word brings its
two halves into Aho-Corasick automata, all words are scanned by these, and a match counts if its
offset is that of its half and the lengths are compatible; the rest of both words is then compared.

A half at the start is held by the shard of the word's first code points, one at the end by the
shard of its last ones, so a word needs to be scanned by two shards only. A shard of many words is
cut into parts of a bounded number, and each part is matched against each: no task holds more than
two parts, whatever the number of words that begin alike.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, whole

#: Maximal runs of letters.
RUNS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points by which words are dealt to shards; no half is shorter.
KEY = 3
#: Shards of each side, and the most words of a part of one.
SHARDS, PART = 256, 20_000
#: Pairs that are compared at once.
BLOCK = 1 << 22


def noisy(run: Column, id_col: str, one_in: int) -> Column:
    """The run, without one code point where its hash with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, times: int = 2, one_in: int = 31) -> DataFrame:
    """(word, n): the words of at least `least` code points that occur at least `times` times over all rows.

    Runs are counted before they move, so a frequent word is one row for each task.
    """
    runs = df.select(id_col, F.explode(F.regexp_extract_all(whole(text_col), F.lit(RUNS + "{" + str(least) + ",}"), F.lit(0))).alias("_run"))
    word = noisy(F.translate("_run", UPPER, LOWER), id_col, one_in)
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _codes(texts: list[str]) -> np.ndarray:
    """Texts of one length as rows of code points."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)


def _common(short: np.ndarray, long: np.ndarray, ends: bool) -> np.ndarray:
    """How many code points each pair of rows has in common from the start, or from the end."""
    alive = np.ones((len(short), len(long)), bool)
    total = np.zeros(alive.shape, np.uint16)
    for c in range(short.shape[1]):
        i, j = (-1 - c, -1 - c) if ends else (c, c)
        alive &= short[:, i, None] == long[None, :, j]
        total += alive
    return total


def one_apart(held: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Which pairs of rows differ by exactly one code point, and what they have in common from the start if their lengths differ."""
    k, m = held.shape[1], seen.shape[1]
    if k == m:
        unlike = np.zeros((len(held), len(seen)), np.uint16)
        for c in range(k):
            unlike += held[:, c, None] != seen[None, :, c]
        return unlike == 1, None
    if k < m:
        first = _common(held, seen, False)
        return first + _common(held, seen, True) >= k, first
    first = _common(seen, held, False).T
    return first + _common(seen, held, True).T >= m, first


def matches(held: list[str], seen: list[str], start: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of held, j of seen) of words one code point apart that share held's first half at the start, or its second half at the end (and not the first as well)."""
    import ahocorasick

    holders: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for i, w in enumerate(held):
        h = len(w) // 2
        holders[w[:h] if start else w[h:]][len(w)].append(i)
    automaton = ahocorasick.Automaton()
    for half in holders:
        automaton.add_word(half, half)
    automaton.make_automaton()
    #: (half, length of the scanned word) -> scanned words that have it in its place
    found: dict[tuple[str, int], list[int]] = defaultdict(list)
    for j, x in enumerate(seen):
        for end, half in automaton.iter(x):
            if end + 1 == (len(half) if start else len(x)):
                found[half, len(x)].append(j)
    left, right = [], []
    for (half, m), js in found.items():
        texts = None
        for n in (m - 1, m, m + 1):
            ids = holders[half].get(n)
            if not ids:
                continue
            rest = slice(len(half), None) if start else slice(None, -len(half))
            texts = _codes([seen[j][rest] for j in js]) if texts is None else texts
            mine = _codes([held[i][rest] for i in ids])
            step = max(1, BLOCK // len(js))
            for a in range(0, len(ids), step):
                part = mine[a : a + step]
                near, first = one_apart(part, texts)
                if not start and first is not None:  # those that share the first half too are found by it
                    near &= ~((first == n // 2) if n < m else (first == m - len(half)) & (part[:, -1:] == ord(half[0])))
                i, j = np.nonzero(near)
                left.append(np.asarray(ids)[a + i])
                right.append(np.asarray(js)[j])
    if not left:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(left), np.concatenate(right)


def _cell(table: pa.Table) -> pa.Table:
    """For each held word of a cell: how many scanned words are near, and the best of them by count, then order."""
    word, n, holds, scans = (table.column(c).to_pylist() for c in ("word", "n", "holds", "scans"))
    held = [i for i, x in enumerate(holds) if x]
    seen = [i for i, x in enumerate(scans) if x]
    near = [0] * len(held)
    best: list[tuple[int, str] | None] = [None] * len(held)
    if held:
        for i, j in zip(*(x.tolist() for x in matches([word[i] for i in held], [word[j] for j in seen], table.column("side")[0].as_py() == 0)), strict=True):
            near[i] += 1
            other = (-n[seen[j]], word[seen[j]])
            if best[i] is None or other < best[i]:
                best[i] = other
    return pa.table({
        "word": pa.array([word[i] for i in held], pa.string()), "n": pa.array([n[i] for i in held], pa.int64()), "n_near": pa.array(near, pa.int64()),
        "best_n": pa.array([b and -b[0] for b in best], pa.int64()), "best": pa.array([b and b[1] for b in best], pa.string()),
    })


def near_words(counted: DataFrame, shards: int = SHARDS, part: int = PART) -> DataFrame:
    """(word, n, n_near, best_n, best) for each word of (word, n): its near words' number and the one of largest n, ties by code-point order.

    What comes to the driver is a count for each shard, whose number is fixed. Words must have six code points or more.
    """
    ends = F.array(*(F.struct(F.lit(side).alias("side"), (F.pmod(F.xxhash64(key), F.lit(shards)) + side * shards).cast("int").alias("shard")) for side, key in enumerate((F.substring("word", 1, KEY), F.substring("word", -KEY, KEY)))))
    dealt = counted.select("word", "n", F.inline(ends))
    parts = {r["shard"]: -(-r["count"] // part) for r in dealt.groupBy("shard").count().collect()}
    if not parts:
        return counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    cut = counted.sparkSession.createDataFrame(sorted(parts.items()), "shard int, parts int")
    dealt = dealt.join(F.broadcast(cut), "shard").withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own"))

    def cell(held: Column, seen: Column, holds: bool, scans: bool) -> Column:
        return F.struct(held.alias("held"), seen.alias("seen"), F.lit(holds).alias("holds"), F.lit(scans).alias("scans"))

    own = F.col("own")
    cells = F.concat(F.array(cell(own, own, True, True)), F.transform(others, lambda i: cell(own, i, True, False)), F.transform(others, lambda i: cell(i, own, False, True)))
    sent = dealt.select("side", "shard", "word", "n", F.inline(cells))
    found = sent.groupBy("shard", "held", "seen").applyInArrow(_cell, "word string, n long, n_near long, best_n long, best string")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("_first")).select("word", "n", "n_near", (-F.col("_first.less")).alias("best_n"), "_first.best")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, times: int = 2, one_in: int = 31, factor: int = 10, shards: int = SHARDS, part: int = PART) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, if that is `factor` times the word's n or more;
    root is the last of its forms. `one_in` is the share of runs of a document that lose a code
    point by their hash. Null and empty texts have no words; a null id counts as empty in the hash.
    Repeated rows count as often as they stand there. A text or a run of any length is taken whole.
    An empty table gives an empty table; other columns don't matter. `factor` must be over one, so
    that forms can't form a ring.
    """
    if least < 2 * KEY or factor < 2:
        raise ValueError(f"words need {2 * KEY} code points or more, and forms twice the count or more")
    counted = durable(words(df, id_col, text_col, least, times, one_in))
    held = F.col("best_n") >= factor * F.col("n")
    near = durable(near_words(counted, shards, part).select("word", "n", "n_near", F.when(held, F.col("best")).alias("form"), F.when(held, F.col("best_n")).alias("form_n")))
    roots = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each step doubles how far a root has been followed
        following = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = durable(roots.join(following, "root", "left"))
        roots = step.select("word", F.coalesce("_next", "root").alias("root"))
        if step.where(F.col("_next").isNotNull()).isEmpty():
            break
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
