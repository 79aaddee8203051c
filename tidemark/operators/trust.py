"""Trust of analyzers: what seeds trust directly or over others, propagated along weighted edges."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.places import durable, parts_for, remove, settings, shared_folder, with_places

#: Nodes whose trust is one row, and edges of such a block that are one row; a block with more is cut into parts.
BLOCK, EDGES = 16_384, 250_000
#: Edges that a task multiplies in a step.
TASK_EDGES = 4_000_000
#: Shuffle partitions stay as many as the edges need: merged ones, of 64 MB, would be fewer than cores or fill them unevenly.
EVEN = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}

PACKED = "_row long, _spots binary, _to binary, _w binary"
SENT = "_block int, _at binary, _got binary"
STATE = "_block int, _parts int, _seed binary, _idle binary, _trust binary, _rests double, _moved double"


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, int)


def _slices(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values: what lies from each start to the next."""
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[kind]) for v, (_, kind) in zip(values, fields)], [name for name, _ in fields])


def _place(part: Column) -> Column:
    """The row of a part of a block's edges, as one number: that is sorted by alone."""
    return F.shiftleft(F.col("_block").cast("long"), 32).bitwiseOR(part.cast("long")).alias("_row")


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = 60, follow: float = 0.85, tolerance: float = 1e-9, part: int = EDGES, block: int = BLOCK) -> DataFrame:
    """(node, trust) for each node of edges (source, target, weight) and seeds (node, share): trust sums to one.

    In each step a node hands the share `follow` of its trust to those it points to, by weight, and
    the rest, with all trust of nodes that point nowhere, goes back to the seeds. A step is a
    sparse matrix times a vector, as a join and an aggregate of blocks: nodes are numbered, the trust
    of `block` of them is one row, and so are about `part` of a block's edges (those of a target
    together). Edges are dealt once and lie still; what moves in a step is trust, added up by target
    within a row of edges. Steps end once trust moves by no more than `tolerance` in all. Edges with
    nulls or without weight don't count, equal ones add up.
    """
    spark = edges.sparkSession
    given = durable(seeds.where(F.col("node").isNotNull() & (F.col("share") > 0)).groupBy("node").agg(F.sum(F.col("share").cast("double")).alias("_seed")))
    total = given.agg(F.sum("_seed")).first()[0]
    if not total:
        raise ValueError("trust needs a seed")
    folder = f"{shared_folder(spark)}/trust-{uuid.uuid4().hex}"
    remove(spark, folder, at_exit=True)
    sound = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("weight") > 0)).groupBy("source", "target").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    with settings(spark, EVEN):
        sound.write.parquet(folder)
    sound = spark.read.schema(sound.schema).parquet(folder)
    number = sound.count()
    with parts_for(spark, number), settings(spark, EVEN):
        ends = sound.select(F.col("source").alias("node"), F.col("weight").alias("_out")).unionByName(sound.select(F.col("target").alias("node")), allowMissingColumns=True).unionByName(given, allowMissingColumns=True)
        nodes = ends.groupBy("node").agg(F.sum("_out").alias("_out"), F.count("_out").alias("_edges"), F.coalesce(F.sum("_seed") / total, F.lit(0.0)).alias("_seed"))
        nodes = with_places(nodes, [F.col("node")], "_n").withColumn("_n", F.col("_n") - 1)
        nodes = nodes.withColumns({"_block": F.floor(F.col("_n") / block).cast("int"), "_spot": (F.col("_n") % block).cast("int")})
        cuts = nodes.groupBy("_block").agg(F.ceil(F.sum("_edges") / part).cast("int").alias("_parts"))
        nodes = durable(nodes.join(cuts, "_block"))
        spots, to = np.min_scalar_type(block - 1), np.min_scalar_type(nodes.count())

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            """A block's edges as one row, by target."""
            order = np.argsort(rows["_n"].to_numpy(), kind="stable")
            column = lambda name, kind: rows[name].to_numpy()[order].astype(kind)
            return pa.Table.from_batches([_row(PACKED, key[0].as_py(), column("_spot", spots), column("_n", to), column("_w", np.float64))])

        away = sound.join(nodes.select(F.col("node").alias("source"), "_block", "_spot", "_parts", "_out").hint("shuffle_hash"), "source").select("target", "_block", "_spot", "_parts", (F.col("weight") / F.col("_out")).alias("_w"))
        both = away.join(nodes.select(F.col("node").alias("target"), "_n").hint("shuffle_hash"), "target").select(_place(F.pmod(F.xxhash64("_n"), F.col("_parts"))), "_spot", "_n", "_w")
        packed = durable(both.groupBy("_row").applyInArrow(pack, PACKED))
    remove(spark, folder)

    def start(key: tuple, rows: pa.Table) -> pa.Table:
        """A block of nodes as one row, all trust with the seeds."""
        rows = rows.sort_by("_spot")
        idle, seed = rows["_out"].combine_chunks().is_null().to_numpy(zero_copy_only=False), rows["_seed"].to_numpy()
        return pa.Table.from_batches([_row(STATE, key[0].as_py(), rows["_parts"][0].as_py(), seed, idle, seed, float(seed[idle].sum()), 0.0)])

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What edges hand on, added up by target, as a row for each block of targets."""
        for batch in batches:
            for mine, theirs, w, trust in zip(*(batch.column(c) for c in ("_spots", "_to", "_w", "_trust"))):
                target = np.frombuffer(theirs.as_buffer(), to)
                first = _firsts(target)
                got = np.add.reduceat(np.frombuffer(trust.as_buffer())[np.frombuffer(mine.as_buffer(), spots)] * np.frombuffer(w.as_buffer()), first)
                blocks, at = np.divmod(target[first].astype(np.int64), block)
                cut = _firsts(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(blocks[cut].astype(np.int32)), _slices(at.astype(spots), cut), _slices(got, cut)], ["_block", "_at", "_got"])

    def turn(rests: float):
        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A block's next trust from its row and from all that was handed to it."""
            sums, own = np.zeros(block), {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["_at"] is None:
                        own = row
                    else:
                        sums[np.frombuffer(row["_at"], spots)] += np.frombuffer(row["_got"])
            seed, idle, before = np.frombuffer(own["_seed"]), np.frombuffer(own["_idle"], bool), np.frombuffer(own["_trust"])
            after = (1 - follow + follow * rests) * seed + follow * sums[: len(seed)]
            yield _row(STATE, own["_block"], own["_parts"], seed, idle, after, float(after[idle].sum()), float(np.abs(after - before).sum()))

        return turned

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, trust in zip(batch.column("_block").to_pylist(), batch.column("_trust")):
                trust = np.frombuffer(trust.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(n * block + np.arange(len(trust))), pa.array(trust)], ["_n", "trust"])

    # Adaptive plans don't tell how a checkpoint's rows are dealt; without that, each step would deal all edges anew.
    tasks = max(spark.sparkContext.defaultParallelism, 1 + number // TASK_EDGES)
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(tasks), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}):
        packed = durable(packed.repartition("_row"))
        state = durable(nodes.select("_block", "_parts", "_spot", "_out", "_seed").groupBy("_block").applyInArrow(start, STATE))
        rests = state.agg(F.sum("_rests")).first()[0]
        for _ in range(steps):
            sent = state.where("_parts > 0").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(_place(F.col("_part")), "_trust")
            got = packed.join(sent.hint("shuffle_hash"), "_row").select("_spots", "_to", "_w", "_trust").mapInArrow(hand, SENT)
            state = durable(state.unionByName(got, allowMissingColumns=True).groupBy("_block").applyInArrow(turn(rests), STATE))
            rests, moved = state.agg(F.sum("_rests"), F.sum("_moved")).first()
            if moved <= tolerance:
                break
        trust = durable(state.select("_block", "_trust").mapInArrow(unpack, "_n long, trust double"))
    return nodes.select("_n", "node").join(trust, "_n").select("node", "trust")
