"""Feedback: strengths from pairwise preferences, and grades from raters of unknown reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.places import durable


def strengths(comparisons: DataFrame, steps: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(item, strength, wins, met) by Bradley and Terry's model from (winner, loser, n): how often who preferred whom.

    Strengths are those of greatest likelihood if everyone has also won and lost once against an item
    of strength one; that makes them finite, unique and comparable whatever the graph of meetings.
    Each minorise-maximise step is a join of the sparse win matrix with the strengths and an
    aggregate, combined before its shuffle; steps end once no logarithm moves by more than
    `tolerance`. Null items and meetings of an item with itself don't count.
    """
    met = comparisons.where((F.col("winner") != F.col("loser")) & (F.col("n") > 0))
    both = met.select(F.col("winner").alias("item"), F.col("loser").alias("other"), "n", F.col("n").alias("won")).unionAll(met.select("loser", "winner", "n", F.lit(0).cast(met.schema["n"].dataType)))
    both = durable(both.groupBy("item", "other").agg(F.sum("n").alias("n"), F.sum("won").alias("won")))
    items = durable(both.groupBy("item").agg(F.sum("won").alias("wins"), F.sum("n").alias("met")))
    state = items.select("item", "wins", "met", F.lit(1.0).alias("strength"))
    for _ in range(steps):
        own, theirs = state.select("item", F.col("strength").alias("_own")), state.select(F.col("item").alias("other"), F.col("strength").alias("_theirs"))
        load = both.join(theirs, "other").join(own, "item").groupBy("item").agg(F.sum(F.col("n") / (F.col("_own") + F.col("_theirs"))).alias("_load"))
        step = durable(state.join(load, "item").withColumn("_next", (F.col("wins") + 1) / (F.col("_load") + 2 / (F.col("strength") + 1))))
        moved = step.agg(F.max(F.abs(F.log(F.col("_next") / F.col("strength"))))).first()[0]
        state = step.select("item", "wins", "met", F.col("_next").alias("strength"))
        if moved is None or moved <= tolerance:
            break
    return state


def _each(grades: int, of) -> list[Column]:
    return [of(j) for j in range(grades)]


def graded(ratings: DataFrame, grades: int, steps: int = 50, tolerance: float = 1e-6, prior: float = 1.0) -> tuple[DataFrame, DataFrame, list[float]]:
    """Items' true grades and raters' confusion by expectation-maximisation (Dawid and Skene) from (rater, item, grade), grades 0 to grades - 1.

    Returns (item, p: the probability of each grade, grade: the likeliest, ratings), (rater, given,
    p: how likely the rater gives that grade to items of each true grade), and the objective after
    each step: the log-likelihood with the prior, which never falls. `prior` is added to each count of a rater's
    confusion, so raters of few ratings stay near to knowing nothing. Ratings out of range or with nulls don't
    count; equal ratings count as often as they stand there. A rater with a third of all ratings, or an item, is summed up in
    part before the shuffle: what moves are counts by (rater, item, grade).
    """
    sound = ratings.where(F.col("rater").isNotNull() & F.col("item").isNotNull() & F.col("grade").between(0, grades - 1))
    counted = durable(sound.groupBy("rater", "item", "grade").agg(F.count("*").cast("double").alias("n")))
    shares = _each(grades, lambda j: F.sum(F.when(F.col("grade") == j, F.col("n")).otherwise(0.0)))
    belief = counted.groupBy("item").agg(F.array(*((s + 1 / grades) / (F.sum("n") + 1) for s in shares)).alias("p"))
    raters = counted.select("rater").distinct().select("rater", F.explode(F.sequence(F.lit(0), F.lit(grades - 1))).alias("grade"))
    objective: list[float] = []
    confusion = raters.withColumn("p", F.lit(None).cast("array<double>"))
    for _ in range(steps):
        weighed = counted.join(belief, "item").groupBy("rater", "grade").agg(*_each(grades, lambda j: F.sum(F.col("n") * F.col("p")[j]).alias(f"_w{j}")))
        counts = raters.join(weighed, ["rater", "grade"], "left").select("rater", "grade", *_each(grades, lambda j: (F.coalesce(f"_w{j}", F.lit(0.0)) + prior).alias(f"_w{j}")))
        totals = counts.groupBy("rater").agg(*_each(grades, lambda j: F.sum(f"_w{j}").alias(f"_t{j}")))
        confusion = durable(counts.join(totals, "rater").select("rater", "grade", F.array(*_each(grades, lambda j: F.col(f"_w{j}") / F.col(f"_t{j}"))).alias("p")))
        mass = belief.agg(*_each(grades, lambda j: F.avg(F.col("p")[j]))).first()
        scored = counted.join(confusion, ["rater", "grade"]).groupBy("item").agg(*_each(grades, lambda j: F.sum(F.col("n") * F.log(F.col("p")[j])).alias(f"_l{j}")))
        logs = F.array(*_each(grades, lambda j: F.col(f"_l{j}") + F.log(F.lit(mass[j] or 1e-300))))
        top = F.array_max(logs)
        parts = F.transform(logs, lambda x: F.exp(x - top))
        total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
        step = durable(scored.select("item", F.transform(parts, lambda x: x / total).alias("p"), (top + F.log(total)).alias("_log")))
        held = confusion.agg(F.sum(F.aggregate("p", F.lit(0.0), lambda a, b: a + F.log(b)))).first()[0] or 0.0
        objective.append((step.agg(F.sum("_log")).first()[0] or 0.0) + prior * held)
        belief = step.select("item", "p")
        if len(objective) > 1 and abs(objective[-1] - objective[-2]) <= tolerance * max(1.0, abs(objective[-1])):
            break
    sizes = counted.groupBy("item").agg(F.sum("n").cast("long").alias("ratings"))
    likeliest = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    return belief.join(sizes, "item").select("item", "p", likeliest.alias("grade"), "ratings"), confusion.withColumnRenamed("grade", "given"), objective
