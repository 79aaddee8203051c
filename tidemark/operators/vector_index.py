"""A vector index: k-means cells, product-quantised residuals, probing and exact re-ranking.

Centroids and codebooks are fitted on a bounded sample chosen by hash (`SAMPLE` rows); every row is
then indexed: its cell, and for each part of the vector the nearest codeword of what is left of it
after its cell's centroid. Rows of a cell lie in blocks of a bounded number, so a cell that holds a
third of all rows is many tasks' work. A query is sent to the blocks of the cells it probes, ranks a
block's rows by their codes, re-ranks the best of them by their vectors, and only its best rows of
each block move on. With all cells probed and all rows re-ranked the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that teach, at most; with 64 floats each they are 10 MB on the driver.
SAMPLE = 40_000
#: Rows of a block, at most about.
BLOCK = 4096
#: Parts of a vector that are quantised, and codewords for each.
PARTS, WORDS = 8, 64
ROUNDS = 12


def k_means(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from rows drawn at random; a cell that loses all its rows keeps its centroid. There are at most as many centroids as different rows."""
    points = np.asarray(points, float)
    different = np.unique(points, axis=0)
    centres = different[np.random.default_rng(seed).permutation(len(different))[:k]]
    for _ in range(rounds):
        nearest = assign(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, in slices of bounded memory."""
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([squares(points[i : i + step], centres).argmin(1) for i in range(0, len(points), step)]) if len(points) else np.empty(0, int)


@dataclass(frozen=True)
class Quantiser:
    """Centroids of cells, for each part of a residual its codewords, and how many cells a query has to probe."""

    centres: np.ndarray
    words: list[np.ndarray]
    probes: int

    def parts(self) -> list[slice]:
        edges = np.linspace(0, self.centres.shape[1], len(self.words) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edges, edges[1:])]

    def codes(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = vectors - self.centres[cells]
        return np.stack([assign(rest[:, p], w) for p, w in zip(self.parts(), self.words)], axis=1).astype(np.uint8)

    def estimates(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to rows of a cell, by their codes: a table look-up for each part."""
        rest = query - self.centres[cell]
        return sum(squares(rest[None, p], w)[0][codes[:, i]] for i, (p, w) in enumerate(zip(self.parts(), self.words)))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows whose vector is there and has no null and no value that isn't finite; others can't be near to anything."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size("vector") > 0))


def probes_needed(points: np.ndarray, cells: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, tries: int = 200) -> int:
    """How many cells must be probed so that of the k nearest others of some points that share is in them, measured on these points."""
    asked = points[:tries]
    far = squares(asked, points)
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(points) - 1)
    if k < 1:
        return len(centres)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    places = np.argsort(np.argsort(squares(asked, centres), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(places, cells[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def fit(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, parts: int = PARTS, words: int = WORDS, recall: float = 0.97) -> Quantiser:
    """Learns from at most `sample` rows of (id, vector), those of least hash. Without `cells` there are as many as the square root of the sampled rows, 8 to 1024. The number of cells to probe is the least
    that reaches `recall` on the sample.
    """
    taken = rows.select(F.xxhash64("id", "vector").alias("_h"), "vector").orderBy("_h").limit(sample).select("vector").toArrow().column(0).to_pylist()
    if not taken:
        raise ValueError("no vectors to learn from")
    points = np.array(taken, float)
    centres = k_means(points, cells or min(1024, max(8, int(len(points) ** 0.5))))
    own = assign(points, centres)
    rest, probes = points - centres[own], probes_needed(points, own, centres, recall)
    q = Quantiser(centres, [np.zeros((1, 1))] * min(parts, points.shape[1]), probes)
    return Quantiser(centres, [k_means(rest[:, p], words, seed=11 + i) for i, p in enumerate(q.parts())], probes)


def encode(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(cell, id, vector, codes) of every row of (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.array(batch.column("vector").to_pylist(), float).reshape(batch.num_rows, -1)
            cells = assign(vectors, quantiser.centres)
            codes = quantiser.codes(vectors, cells) if len(vectors) else np.empty((0, len(quantiser.words)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), batch.column("id"), batch.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "vector", "codes"])

    return rows.mapInArrow(run, "cell int, id long, vector array<double>, codes binary")


def blocks(coded: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds block: which part of its cell a row is in, cut by hash into parts of about `block` rows. The cells' sizes are at most as many rows as there are centroids."""
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    return coded.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))


def nearest(coded: DataFrame, queries: DataFrame, quantiser: Quantiser, k: int = 10, probes: int | None = None, rerank: int | None = 200, block: int = BLOCK) -> DataFrame:
    """query, rn, id, distance: for each row of queries (id, vector) the k nearest others of the cells it probes, by squared distance rounded to 6 places, then id.

    `rerank` rows of a block, the best by their codes, are measured by their vectors; None measures all. Without `probes` it is
    as many as the quantiser was fitted for. With
    probes of all cells as well the result is exact. A query never finds a row of its own id.
    """
    centres = quantiser.centres
    probes = min(probes or quantiser.probes, len(centres))
    dealt = blocks(coded, block)
    there = dealt.select(F.col("cell").alias("at_cell"), F.col("block").alias("at_block")).distinct()

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.array(batch.column("vector").to_pylist(), float)
                cells = np.argpartition(squares(vectors, centres), probes - 1, axis=1)[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["query", "vector", "cells"])

    asked = queries.mapInArrow(probed, "query long, vector array<double>, cells array<int>").select("query", "vector", F.explode("cells").alias("at_cell")).join(there, "at_cell")

    def ranked(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if rows.num_rows and asking.num_rows:
            cell = rows.column("cell")[0].as_py()
            ids = np.array(rows.column("id").to_pylist(), np.int64)
            vectors = np.array(rows.column("vector").to_pylist(), float)
            codes = np.stack([np.frombuffer(c, np.uint8) for c in rows.column("codes").to_pylist()])
            for query, vector in zip(asking.column("query").to_pylist(), np.array(asking.column("vector").to_pylist(), float), strict=True):
                chosen = np.nonzero(ids != query)[0]
                if rerank is not None and len(chosen) > rerank:
                    chosen = chosen[np.argpartition(quantiser.estimates(vector, cell, codes[chosen]), rerank - 1)[:rerank]]
                far = np.round(((vectors[chosen] - vector) ** 2).sum(1), 6)
                for i in np.lexsort((ids[chosen], far))[:k].tolist():
                    out.append((query, int(ids[chosen[i]]), float(far[i])))
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("query", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())))})

    found = dealt.select("cell", "block", "id", "vector", "codes").groupBy("cell", "block").cogroup(asked.groupBy("at_cell", "at_block")).applyInArrow(ranked, "query long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rn", place).where(F.col("rn") <= k).select("query", "rn", "id", "distance")
