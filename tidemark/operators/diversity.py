"""Ranking signals: freshness, novelty and diversity."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.places import durable


def freshness(added_at: Column, now: int, half_life: float) -> Column:
    """One for what is new, a half after each half-life; what is from the future counts as new."""
    age = F.greatest(F.lit(0), F.lit(now) - added_at.cast("double"))
    return F.pow(F.lit(0.5), age / half_life)


def novelty(entries: DataFrame, seen: DataFrame, user: str, topic: str) -> DataFrame:
    """(user, topic, novelty) for each of entries' topics: 1 / (1 + how often the user has seen it)."""
    times = seen.groupBy(user, topic).agg(F.count("*").alias("_times"))
    return entries.select(user, topic).distinct().join(times, [user, topic], "left").select(user, topic, (1 / (1 + F.coalesce("_times", F.lit(0)))).alias("novelty"))


def greedy(ids: np.ndarray, relevance: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> list[tuple[int, float]]:
    """Places of the k items that greedy maximal marginal relevance picks, with their scores.

    The marginal score of an item only falls as more are picked, so its last known score is a bound:
    an item is measured against what was picked since only once it stands first by its bound.
    Ties go to the smaller id.
    """
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors / np.where(norms > 0, norms, 1)[:, None]
    worst = np.full(len(ids), -np.inf)
    checked = [0] * len(ids)
    heap = [(-round(balance * float(r), 9), int(i), n) for n, (r, i) in enumerate(zip(relevance, ids, strict=True))]
    heapq.heapify(heap)
    picked: list[int] = []
    out: list[tuple[int, float]] = []
    while heap and len(picked) < k:
        bound, i, n = heapq.heappop(heap)
        if checked[n] == len(picked):
            picked.append(n)
            out.append((n, -bound))
            continue
        new = float((units[picked[checked[n] :]] @ units[n]).max())
        worst[n] = max(worst[n], new)
        checked[n] = len(picked)
        # Likeness below zero counts as none, so the first score is a bound for all later ones.
        heapq.heappush(heap, (-round(balance * float(relevance[n]) - (1 - balance) * max(0.0, worst[n]), 9), i, n))
    return out


def _rounds(items: DataFrame, key: str, k: int, balance: float) -> DataFrame:
    """The same picks by one aggregate and one join for each, for groups of any size: none is gathered."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, b: a + b * b))
    unit = F.transform("vector", lambda x: x / F.when(length > 0, length).otherwise(1.0))
    left = durable(items.select(key, "id", "relevance", unit.alias("vector"), F.lit(0.0).alias("_worst")))
    score = F.round(balance * F.col("relevance") - (1 - balance) * F.col("_worst"), 9)
    picks = []
    for n in range(1, k + 1):
        best = left.withColumn("score", score).groupBy(key).agg(F.max_by(F.struct("id", "score", "vector"), F.struct("score", -F.col("id"))).alias("_best"))
        best = durable(best.select(key, F.lit(n).alias("rn"), F.col("_best.id").alias("_id"), "_best.score", F.col("_best.vector").alias("_vector")))
        picks.append(best.select(key, "rn", F.col("_id").alias("id"), "score"))
        like = F.aggregate(F.zip_with("vector", "_vector", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        left = durable(left.join(best.select(key, "_id", "_vector"), key).where(F.col("id") != F.col("_id")).select(key, "id", "relevance", "vector", F.greatest("_worst", like).alias("_worst")))
    return reduce(DataFrame.unionByName, picks)


def diverse(items: DataFrame, key: str, k: int = 20, balance: float = 0.7, pool: int = 2000) -> DataFrame:
    """(key, rn, id, score): of items (key, id, relevance, vector) the k that greedy maximal marginal relevance picks for each key.

    score = balance x relevance - (1 - balance) x the largest cosine to an item that was picked before, none below
    zero; ties go to the smaller id. Only the `pool` most relevant items of a key are gathered. If the last of their picks
    scores more than any item beyond them could, they are the picks of the whole group; the
    other groups, such as large ones of like relevance, are picked round by round where their rows lie.
    Rows with a null key, relevance, id or vector don't take part; an id stands once in a key.
    """
    sound = items.where(F.col(key).isNotNull() & F.col("relevance").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull())
    sound = sound.select(key, F.col("id").cast("long").alias("id"), F.col("relevance").cast("double").alias("relevance"), F.col("vector").cast("array<double>").alias("vector"))
    first = sound.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("relevance"), "id"))).where(F.col("_nth") <= pool + 1)

    def picked(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_nth")
        ids, relevance = rows.column("id").to_numpy(), rows.column("relevance").to_numpy()
        vectors = np.array(rows.column("vector").to_pylist(), float)
        got = greedy(ids[:pool], relevance[:pool], vectors[:pool], k, balance)
        if len(ids) > pool and (len(got) < k or min(s for _, s in got) <= round(balance * float(relevance[pool]), 9)):
            got = []  # not settled by the pool
        places = [n for n, _ in got] or [0]
        return pa.table({key: rows.column(key).take(places), "rn": pa.array(range(1, len(got) + 1) if got else [0], pa.int32()), "id": pa.array([int(ids[n]) for n in places], pa.int64()), "score": pa.array([s for _, s in got] or [None], pa.float64())})

    kind = items.schema[key].dataType.simpleString()
    told = durable(first.groupBy(key).applyInArrow(picked, f"{key} {kind}, rn int, id long, score double"))
    settled, open_ = told.where("rn > 0"), told.where("rn = 0").select(F.col(key).alias("_key"))
    if open_.isEmpty():
        return settled
    rest = sound.join(open_, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return settled.unionByName(_rounds(rest, key, k, balance))
