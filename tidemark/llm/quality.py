"""Operator 5: a quality classifier by ordinal cumulative-link regression.

Documents have graded ratings: 0 toxic, 1 junk, 2 good. One weight for each hashed word and
word shape is shared by all grades; ordered thresholds cut the score into grades:
    P(grade >= k) = sigmoid(score - threshold_k).
The expected grade ranks documents and the tail probability P(grade >= 2) selects them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, whole

DIMENSIONS = 1 << 18
#: Labelled documents to learn from at most, by hash of id; longer ones teach nothing. A text has at most four bytes of
#: features for each of its own, so what comes to the driver is bounded.
SAMPLE_DOCS, SAMPLE_BYTES = 12_000, 16_384
GRADES = 3
#: Training documents that a feature must have to get a weight.
LEAST_DOCS = 8
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SHAPE = re.compile(r"[^\W\d_]+|\d+")


def shape(word: str) -> str:
    """What a word looks like: case, digits and the marks around them."""
    return SHAPE.sub(lambda m: "9" if m.group()[0].isdigit() else "X" if m.group().isupper() and len(m.group()) > 1 else "x" if m.group().islower() else "Xx", word)[:12]


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % DIMENSIONS


class Features:
    """Hashed features of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> np.ndarray:
        """Distinct hashed words and shapes, with buckets for repetition and shouting."""
        words = text.split()
        distinct = set(words)
        known, out = self.known, set()
        if len(known) > 300_000:
            known.clear()
        for w in distinct:
            pair = known.get(w)
            if pair is None:
                pair = known[w] = (hashed("w:" + (EDGES.sub("", w) or w).lower()), hashed("s:" + shape(w)))
            out.update(pair)
        if words:
            out.add(hashed(f"distinct:{min(10, int(math.log2(len(words) / len(distinct)) * 4))}"))
            odd = sum(1 for w in words if not w[-1].isalnum() and not w[:-1].isalnum())
            out.add(hashed(f"odd:{int(10 * odd / len(words))}"))
            out.add(hashed(f"capitals:{int(10 * sum(w.isupper() for w in words) / len(words))}"))
        return np.sort(np.fromiter(out, dtype=np.int32, count=len(out)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def slopes(weights: np.ndarray, thresholds: np.ndarray, flat: np.ndarray, row: np.ndarray, grades: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The log-likelihood weighed by share, and its slopes by weight and by threshold; flat and row list the documents' features."""
        n = len(grades)
        score = np.bincount(row, weights[flat], minlength=n)
        tails = np.column_stack([np.ones(n), *(sigmoid(score - t) for t in thresholds), np.zeros(n)])
        upper, lower = tails[np.arange(n), grades], tails[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = share * (up - low)
        by_threshold = np.array([-(share * up)[grades == k].sum() + (share * low)[grades == k - 1].sum() for k in range(1, GRADES)])
        return float((share * np.log(p)).sum()), np.bincount(flat, by_score[row], minlength=len(weights)), by_threshold

    @staticmethod
    def fit(docs: list[np.ndarray], grades: np.ndarray, rounds: int = 200, rate: float = 0.3, decay: float = 1e-3) -> OrdinalModel:
        """Full-batch AdaGrad on the mean log-likelihood, averaged over the last half; classes weigh by the root of their share."""
        weights = np.zeros(DIMENSIONS)
        thresholds = np.array([-1.0, 1.0])
        if not len(docs):
            return OrdinalModel(weights, thresholds)
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs) if sizes.sum() else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(docs)), sizes)
        # Features of few documents would only let the fit learn those documents by heart.
        common = np.bincount(flat, minlength=DIMENSIONS)[flat] >= min(LEAST_DOCS, 1 + len(docs) // 50)
        flat, row = flat[common], row[common]
        counts = np.bincount(grades, minlength=GRADES)
        share = np.sqrt(len(docs) / np.maximum(counts, 1))[grades]
        share /= share.sum()
        mean, mean_t, late = np.zeros(DIMENSIONS), np.zeros(2), range(rounds // 2, rounds)
        seen, seen_t = np.full(DIMENSIONS, 1e-8), np.full(2, 1e-8)
        for step in range(rounds):
            _, slope, slope_t = OrdinalModel.slopes(weights, thresholds, flat, row, grades, share)
            slope -= decay * weights
            seen += slope**2
            seen_t += slope_t**2
            weights += rate * slope / np.sqrt(seen)
            thresholds += 0.1 * slope_t / np.sqrt(seen_t)
            thresholds[1] = max(thresholds[1], thresholds[0] + 0.05)
            if step in late:
                mean += weights / len(late)
                mean_t += thresholds / len(late)
        return OrdinalModel(mean, mean_t)

    def tails(self, features: np.ndarray) -> tuple[float, float]:
        """P(grade >= 1) and P(grade >= 2)."""
        score = float(self.weights[features].sum())
        a, b = (float(sigmoid(score - t)) for t in self.thresholds)
        return a, b


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 junk, 2 good; the lowest of repeated labels. Rows without a quality don't count."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    grade = F.when(toxic, 0).when(F.col("quality") > 0, 2).when(F.col("quality").isNotNull(), 1)
    return labels.select(F.col("doc_id").alias("_label_id"), grade.cast("int").alias("_grade")).where("_grade is not null and _label_id is not null").groupBy("_label_id").agg(F.min("_grade").alias("_grade"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS, held_out: bool = False) -> OrdinalModel:
    """Learns from `sample` labelled documents at most, chosen by hash of their id.

    Texts of more than SAMPLE_BYTES teach nothing. held_out leaves out documents whose crc32(id)
    mod 4 is 2, to measure on them. Without labels all weights are 0.
    """
    small_batches(docs.sparkSession)
    chosen = graded(labels)
    if held_out:
        chosen = chosen.where(F.crc32(F.col("_label_id").cast("string").cast("binary")) % 4 != 2)
    chosen = chosen.orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features.of(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())], names=["_label_id", "_grade", "_features"])

    # Ids and grades are broadcast, texts stay. Rows with one id teach once, so at most `sample` rows come.
    labelled = docs.where(F.octet_length(whole(text_col)) <= SAMPLE_BYTES).select(F.col(id_col).alias("_doc_id"), whole(text_col).alias("_text"))
    kind = chosen.schema["_label_id"].dataType.simpleString()
    taught = labelled.join(F.broadcast(chosen), F.col("_doc_id") == F.col("_label_id")).select("_label_id", "_grade", "_text").mapInArrow(run, f"_label_id {kind}, _grade int, _features binary")
    rows = taught.groupBy("_label_id").agg(F.min(F.struct("_grade", "_features")).alias("_x")).select("_x.*").collect()
    rows.sort(key=lambda r: (r["_grade"], bytes(r["_features"])))
    return OrdinalModel.fit([np.frombuffer(r["_features"], np.int32) for r in rows], np.array([r["_grade"] for r in rows], dtype=int))


def score_quality(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, expected_grade, p_good (the tail probability of grade 2), kept (p_good >= 0.5).

    Null counts as empty; an empty text has no features and gets the thresholds' own
    probabilities. Very long texts are scored whole, repeated rows alike; an empty table gives an
    empty table; other columns don't matter.
    """
    small_batches(docs.sparkSession)
    verdict = verdicts(model)
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    return texts.select("_id", verdict("_text").alias("_v")).select(F.col("_id").alias(id_col), "_v.expected_grade", "_v.p_good", (F.col("_v.p_good") >= 0.5).alias("kept"))


def verdicts(model: OrdinalModel):
    """A function of a text column: struct of expected_grade and p_good."""

    @F.pandas_udf("struct<expected_grade:double,p_good:double>")
    def verdict(texts):
        import pandas as pd

        features = Features()
        got = [model.tails(features.of(t)) for t in texts]
        return pd.DataFrame({"expected_grade": [a + b for a, b in got], "p_good": [b for _, b in got]}, dtype=float)

    return verdict


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from labels (doc_id, quality, toxic) and scores all documents; see fit_quality and score_quality.

    Labels without an id or without a quality don't count, and of repeated ones the lowest does.
    """
    return score_quality(docs, fit_quality(docs, labels, id_col, text_col), id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, whatever these are called."""
    verdict = verdicts(fit_quality(docs, labels, id_col, text_col))
    return docs.where(verdict(whole(text_col))["p_good"] >= 0.5)
