"""Operator 4: mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A copy's virtual finish time is the number of
its source's words up to and with it, divided by the source's target; later epochs follow the
first. Copies are dealt by ranges of finish time and taken in that order until the budget is
spent; a copy that would start after its source has had its target isn't in the queue. DataFrame functions only.

No source is summed up in one task: its shuffle order is cut into buckets, whose sums give the
running totals at which each bucket starts. Rows that are equal in every column are counted and
stand in the order by chunks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, identity, partitions, whole

#: A word for mixing: what ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of the shuffle order and of finish times, for each shuffle partition.
BUCKETS = 8
#: Equal rows that go together; more of them are several chunks.
CHUNK = 1000


def cyclic_weights(sources: list[str | None], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, int]:
    """Weights 1, 2, 3, 1, ... in code point order, null last."""
    ordered = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def reshare(sizes: dict[str | None, int], weights: dict[str | None, int], budget: int, most: int) -> dict[str | None, float]:
    """Shares of the budget by weight; none above most x its size, the excess shared again."""
    target: dict[str | None, Fraction] = {}
    left, open_ = Fraction(budget), {s for s in sizes if weights[s] > 0}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weights[s] / total for s in open_}
            break
        target |= {s: Fraction(most * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return {s: float(target.get(s, 0)) for s in sizes}


def chunks(n: str) -> Column:
    return F.sequence(F.lit(0), F.floor((F.col(n) - 1) / CHUNK).cast("int"))


def mix_positions(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: dict | None, most: int, seed: int) -> DataFrame:
    """For each row: _id, _key and _chunk (of the row), size, source_size, target, and _finishes: finish times of its taken copies."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).alias("_id"),
        identity(df).alias("_key"),
        F.col(source_col).alias("_source"),
        F.regexp_count(whole(text_col), F.lit(WORD)).cast("long").alias("size"),
    )
    # Rows that are equal in every column are counted before the shuffle and go on as chunks of their number.
    rows = rows.groupBy("_key").agg(*(F.first(c).alias(c) for c in ("_id", "_source", "size")), F.count("*").alias("_n"))
    rows = rows.withColumn("_chunk", F.explode(chunks("_n"))).withColumn("_times", F.least(F.lit(CHUNK), F.col("_n") - F.col("_chunk") * CHUNK))
    shuffled = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), "_key", F.col("_chunk").cast("string"))), 1, 15), 16, 10).cast("long")
    rows = durable(rows.withColumn("_u", shuffled).withColumn("_all", F.col("size") * F.col("_times")).drop("_n"))
    # One row for each source: as many as the mix has weights.
    found = rows.groupBy("_source").agg(F.sum("_all").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["_source"]: r["size"] for r in found}
    budget = sum(sizes.values())
    weights = cyclic_weights(list(sizes)) if weights is None else {s: weights.get(s, 0) for s in sizes}
    target = reshare(sizes, weights, budget, most)
    n_rows, many = max(1, sum(r["n"] for r in found)), BUCKETS * partitions(spark)
    table = [(i, r["_source"], r["size"], target[r["_source"]], max(1, -(-many * r["n"] // n_rows))) for i, r in enumerate(sorted(found, key=lambda r: (r["_source"] is None, r["_source"] or "")))]
    sources = spark.createDataFrame(table, "_rank int, _of string, source_size long, target double, _buckets int")
    rows = rows.join(F.broadcast(sources) if len(table) <= 10_000 else sources, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")

    part = F.floor(F.col("_u").cast("double") / F.lit(2.0**60) * F.col("_buckets")).cast("int")
    rows = rows.withColumn("_part", F.least(part, F.col("_buckets") - 1))
    before = Window.partitionBy("_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_rank", "_part").agg(F.sum("_all").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_rank", "_part").orderBy("_u", "_key", "_chunk").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum("_all").over(within) - F.col("_all")).join(sums, ["_rank", "_part"])
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    rows = durable(rows.withColumn("_sofar", F.col("_before") + F.col("_local") + F.col("_nth") * F.col("size")).drop("_part", "_u", "_before", "_local", "_buckets", "_source", "_all", "_times", "_nth"))

    # A source that has had its target rests, so what a long text leaves of the budget doesn't go to the others beyond theirs.
    epochs = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: e * F.col("source_size") + F.col("_sofar") - F.col("size") < F.col("target"))
    finishes = F.transform(epochs, lambda e: (e * F.col("source_size") + F.col("_sofar")) / F.col("target"))
    # Ranges widen with the time beyond 1, which long texts alone reach; that keeps their number small.
    at = F.when(F.col("_finish") < 1, F.col("_finish")).otherwise(1 + F.log2("_finish"))
    copies = rows.where((F.col("size") > 0) & (F.col("target") > 0)).select("_rank", "size", F.explode(finishes).alias("_finish")).withColumn("_range", F.floor(at * many))
    # As many sums as there are ranges: some for each shuffle partition.
    ranges = sorted((r["_range"], r["n"]) for r in copies.groupBy("_range").agg(F.sum("size").alias("n")).collect())
    spent, last = 0, None
    for at, n in ranges:
        if spent + n > budget:
            last = at
            break
        spent += n
    cut = (float("inf"), 0)
    if last is not None:
        upto = Window.partitionBy("_range").orderBy("_finish", "_rank").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.where(F.col("_range") == last).withColumn("_upto", F.sum("size").over(upto) + spent)
        end = edge.agg(F.max(F.when(F.col("_upto") <= budget, F.struct("_finish", "_rank"))).alias("x"), F.min("_finish").alias("first")).first()
        cut = (end["x"]["_finish"], end["x"]["_rank"]) if end["x"] else (end["first"], -1)
    taken = F.filter(finishes, lambda f: (f < cut[0]) | ((f == cut[0]) & (F.col("_rank") <= cut[1])))
    return rows.withColumn("_finishes", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.array().cast("array<double>")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, most: int = 3, seed: int = 17) -> DataFrame:
    """How much of each document the mix takes: id, size, source_size, target, taken.

    The budget is the sum of all sizes. Without weights the sources weigh 1, 2, 3, 1, ... in
    code point order, null last; a source that given weights don't name takes no part. Targets
    stop at `most` times a source's size, and what a source has taken differs from its target by
    less than its largest document. Null text has size 0 and is never taken, a null
    source is a source, repeated rows count each, whatever their number; a very long text is
    taken whole or not at all. The shuffle depends on the rows' values and the seed alone, so
    reruns agree. An empty table gives an empty table.
    """
    rows = mix_positions(df, id_col, text_col, source_col, weights, most, seed)
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.size("_finishes") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, most: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: a row with all columns of df, whatever these are called, for each copy taken, in order of finish time."""
    copies = mix_positions(df, id_col, text_col, source_col, weights, most, seed).select("_key", "_chunk", F.explode("_finishes").alias("_finish"))
    docs = df.select(F.struct("*").alias("_doc"), identity(df).alias("_key")).groupBy("_key").agg(F.first("_doc").alias("_doc"), F.count("*").alias("_n"))
    docs = docs.select("_key", "_doc", F.explode(chunks("_n")).alias("_chunk"))
    return copies.join(docs, ["_key", "_chunk"]).orderBy("_finish", "_key").select("_doc.*")
