"""Operator 10: similarity self-join on word shingles by the chosen-path method.

A document is the set of its five-word shingles; documents with one set are one node. In each
run a node walks down a tree: at every level it enters the children named by those tokens of
its MinHash sketch that a hash of the path picks, 1 / similarity of them on average. Buckets
that are small are compared by brute force, larger ones are split at the next level, and
independent runs repeat this until the target recall. Pairs that look alike by their sketches
tie nodes into candidate components, within which exact Jaccard similarities decide.

Groups too large for one task are cut into blocks, and every pair of blocks is compared on its
own; links are counted where they are found, so no list of pairs is ever made. Pairs of blocks are
dealt to so many slots that a slot has about as many rows and bytes however large a group is. The
exact number of links has its price: a group of n different texts is n / 2048 times sent and n x n / 2
times compared, if only in products of matrices.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, one_of_each, partitions, row_key, small_batches, whole
from tidemark.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Length of the sketch, levels of the tree, nodes of a bucket that isn't split further, nodes of a block.
SKETCH, DEPTH, SMALL, BLOCK = 64, 3, 256, 2048
#: Nodes, and bytes of their texts, that are compared together, on average at most.
NODES_A_SLOT, BYTES_A_SLOT = 4096, 16 << 20
#: Bytes of texts of a block, at most about; a pair of blocks is compared in one task.
BLOCK_BYTES = 32 << 20
#: Shingles that are multiplied at a time.
COLUMNS = 4096
RECALL = 0.999
#: Deviations of a sketch's estimate that a candidate may lie below the similarity.
SLACK = 4.0
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def runs_needed(depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs until a pair at the similarity is found with that probability, even at the last level.

    A pair shares 1 / similarity x similarity = 1 child on average, so it survives a level with
    probability 1 - exp(-what the levels below give).
    """
    found = 1.0
    for _ in range(depth):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


class Words(dict):
    """Hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def shingles(text: str, words: Words) -> np.ndarray:
    """Distinct hashes of runs of five lower-cased words, sorted; of all words if they are fewer."""
    w = np.fromiter(map(words.__getitem__, text.lower().split()), dtype=np.uint64)
    if not len(w):
        return w
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = mixed(h + w[j : len(w) - size + 1 + j])
    return np.unique(h)


def seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(s: np.ndarray) -> np.ndarray:
    """MinHash values, one for each seed."""
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    by = seeds(SKETCH)
    for a in range(0, len(s), 4096):
        h = (s[a : a + 4096, None] ^ (s[a : a + 4096, None] >> np.uint64(32))) * by
        out = np.minimum(out, (h >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def set_name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def described(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row: _row, _id, _key (of the row), _bytes, _set (name of the set; null if empty), _sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column(4)]
            names = pa.array([set_name(s) if len(s) else None for s in sets], pa.binary())
            sketches = pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], names, sketches], names=["_row", "_id", "_key", "_bytes", "_set", "_sketch"])

    key = row_key(id_col, text_col)
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), key.alias("_key"), F.octet_length(whole(text_col)).cast("long").alias("_bytes"), whole(text_col).alias("_text"))
    rows = rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_key", "_bytes", "_text")
    return rows.mapInArrow(run, f"_row long, _id {df.schema[id_col].dataType.simpleString()}, _key string, _bytes long, _set binary, _sketch binary")


def chosen_paths(nodes: DataFrame, paths: DataFrame | None, runs: int) -> DataFrame:
    """(path, node) of the children that nodes enter: from the roots of all runs, or from given (path, node)."""
    threshold = np.uint64(int(2**64 / (SIMILARITY * SKETCH)))
    place, from_roots = seeds(SKETCH + 1)[1:], paths is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                node = part.column(0).to_numpy()
                tokens = mixed(np.stack([np.frombuffer(s.as_py(), np.uint32) for s in part.column(1)]).astype(np.uint64) + place)
                starts = [np.full(len(node), x, np.uint64) for x in seeds(runs)] if from_roots else [part.column(2).to_numpy().view(np.uint64)]
                for start in starts:
                    h = mixed(tokens ^ start[:, None])
                    i, j = np.nonzero(h < threshold)
                    child = mixed(h[i, j] + start[i])
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(node[i])], names=["path", "node"])

    rows = nodes.select("node", "_sketch")
    if paths is not None:
        rows = paths.join(rows, "node").select("node", "_sketch", "path")
    return rows.mapInArrow(run, "path long, node long")


def leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """(path, node, n) of buckets with two nodes or more that aren't split further."""
    done, paths = None, None
    for level in range(1, DEPTH + 1):
        entered = durable(chosen_paths(nodes, paths, runs))
        sizes = entered.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        entered = durable(entered.join(sizes, "path").select("path", "node", "n"))
        small = entered if level == DEPTH else entered.where(F.col("n") <= SMALL)
        done = small if done is None else done.unionByName(small)
        paths = entered.where(F.col("n") > SMALL).select("path", "node")
        if level == DEPTH or paths.isEmpty():
            return done
    return done


def parts(n: str, size: str | None = None) -> Column:
    """Into how many blocks a group is cut: by its nodes and, if given, by its bytes."""
    by_nodes = F.ceil(F.col(n) / BLOCK)
    return (F.greatest(by_nodes, F.ceil(F.col(size) / BLOCK_BYTES)) if size else by_nodes).cast("int")


def in_blocks(df: DataFrame, group: str, node: str, many: Column) -> DataFrame:
    """Adds _i, _j, _side: groups of more than one block are dealt to pairs of blocks, others stay whole."""
    own = F.pmod(F.xxhash64(node, group), many).cast("int")
    pairs = F.when(many <= 1, F.array(F.struct(F.lit(0).alias("_i"), F.lit(0).alias("_j"), F.lit(0).alias("_side")))).otherwise(
        F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.struct(F.least(k, own).alias("_i"), F.greatest(k, own).alias("_j"), (k < own).cast("int").alias("_side")))
    )
    return df.withColumn("_b", F.explode(pairs)).select("*", "_b.*").drop("_b")


def slot_count(groups: DataFrame, many: Column, size: str | None = None) -> int:
    """Slots among which all pairs of blocks of groups' nodes are dealt, by their rows and, if given, their bytes; a node is in as many pairs as its group has blocks."""
    sent = many.cast("long")
    sums = groups.agg(F.sum(sent).alias("rows"), F.sum(sent * F.col(size) if size else F.lit(0)).alias("bytes")).first()
    return max(4 * partitions(groups.sparkSession), (sums["rows"] or 0) // NODES_A_SLOT, (sums["bytes"] or 0) // BYTES_A_SLOT)


def in_slots(df: DataFrame, group: str, slots: int) -> DataFrame:
    """Adds _slot to rows of in_blocks: a pair of blocks is in one slot."""
    return df.withColumn("_slot", F.pmod(F.xxhash64(group, "_i", "_j"), F.lit(slots)))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    up = np.arange(n)
    while True:
        before = up.copy()
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        up = up[up]
        if (up == before).all():
            return up


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    order = np.lexsort(keys[::-1])
    if not len(order):
        return
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    yield from np.split(order, np.flatnonzero(new)[1:])


def alike(left: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sketches agree in `least` places or more."""
    a, b = [], []
    other = left if right is None else right
    for i in range(0, len(left), 64):
        same = np.zeros((len(left[i : i + 64]), len(other)), np.uint16)
        for k in range(SKETCH):
            same += left[i : i + 64, k, None] == other[None, :, k]
        x, y = np.nonzero(same >= least)
        if right is None:
            x, y = x[x + i < y], y[x + i < y]
        a.append(x + i)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def candidate_edges(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """A forest of (a, b) over the nodes of each bucket that look alike."""
    least = SKETCH * max(0.0, SIMILARITY - SLACK * math.sqrt(SIMILARITY * (1 - SIMILARITY) / SKETCH))

    def compare(table: pa.Table) -> pa.Table:
        node, path, i, j, side = (table.column(c).to_numpy() for c in ("node", "path", "_i", "_j", "_side"))
        marks = np.stack([np.frombuffer(s, np.uint32) for s in table.column("_sketch").to_pylist()])
        a, b = [], []
        for rows in _groups(path, i, j):
            if len(rows) < 2:
                continue
            if i[rows[0]] == j[rows[0]]:
                x, y = alike(marks[rows], None, least)
                x, y = rows[x], rows[y]
            else:
                left, right = rows[side[rows] == 0], rows[side[rows] == 1]
                if not len(left) or not len(right):
                    continue
                x, y = alike(marks[left], marks[right], least)
                x, y = left[x], right[y]
            if not len(x):
                continue
            members, back = np.unique(np.concatenate((node[x], node[y])), return_inverse=True)
            root = members[roots(len(members), back[: len(x)], back[len(x) :])]
            a.append(members[members != root])
            b.append(root[members != root])
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    rows = in_blocks(found, "path", "node", parts("n")).join(nodes.select("node", "_sketch"), "node")
    return in_slots(rows, "path", slot_count(found, parts("n"))).groupBy("_slot").applyInArrow(compare, "a long, b long")


def linked(sets: list[np.ndarray], side: np.ndarray, within: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with the similarity; across the sides only, unless within. Counts are integers, so exact."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = (np.arange(n), np.arange(n)) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    place = np.zeros(n, np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    # Shingles in the order of the first set that has them: neighbours then are in much the same sets.
    _, first, column = np.unique(column, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    column = number[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.int32)
    for a in range(0, len(first), COLUMNS):
        low, high = np.searchsorted(column, (a, a + COLUMNS))
        active, at = np.unique(row[low:high], return_inverse=True)
        m = np.zeros((len(active), COLUMNS), np.float32)
        m[at, column[low:high] - a] = 1
        i, j = (np.arange(len(active)), np.arange(len(active))) if within else (np.flatnonzero(side[active] == 0), np.flatnonzero(side[active] == 1))
        if len(i) and len(j):
            both[np.ix_(place[active[i]], place[active[j]])] += (m[i] @ m[j].T).astype(np.int32)
    ratio = Fraction(str(similarity))
    found = []
    for a in range(0, len(left), 256):
        enough = both[a : a + 256].astype(np.int64) * (ratio.denominator + ratio.numerator) >= ratio.numerator * (sizes[left[a : a + 256], None] + sizes[None, right])
        x, y = np.nonzero(enough)
        x, y = left[x + a], right[y]
        ok = (x < y) if within else np.ones(len(x), bool)
        found.append((x[ok], y[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: _row, _id, _key, _class (a number), n_links."""
    rows = durable(described(df, id_col, text_col))
    sets = rows.where(F.col("_set").isNotNull()).groupBy("_set")
    nodes = durable(sets.agg(F.min("_row").alias("node"), F.count("*").alias("_copies"), F.first("_sketch").alias("_sketch"), F.min(F.struct("_row", "_key", "_bytes")).alias("_first")).select("_set", "node", "_copies", "_sketch", "_first._key", "_first._bytes"))
    edges = candidate_edges(nodes, leaves(nodes, runs_needed()))
    near = components(edges)
    near = near.join(nodes.drop("_sketch"), "node")
    group_sizes = near.groupBy("root").agg(F.count("*").alias("n"), F.sum("_bytes").alias("_size"))
    members = durable(near.join(group_sizes, "root"))

    text_key = row_key(id_col, text_col)
    texts = df.select(text_key.alias("_key"), whole(text_col).alias("_text"))
    asked = members.select("_key", "root", "node", "n", "_size", "_copies")
    # Rows that are repeated many times would fill one task; one of each key is enough.
    many = parts("n", "_size")
    cut = in_slots(in_blocks(texts.join(asked, "_key").dropDuplicates(["_key"]), "root", "node", many), "root", slot_count(members, many, "_bytes"))

    def verify(table: pa.Table) -> pa.Table:
        words = Words()
        node, root, i, j, side, copies = (table.column(c).to_numpy() for c in ("node", "root", "_i", "_j", "_side", "_copies"))
        text = table.column("_text")
        out: list[list[np.ndarray]] = [[], [], []]
        for group in _groups(root, i, j):
            if len(group) < 2:
                continue
            own = [shingles(text[int(k)].as_py(), words) for k in group]
            a, b = linked(own, side[group], i[group[0]] == j[group[0]], SIMILARITY)
            if not len(a):
                continue
            n, c = len(group), copies[group]
            links = np.bincount(a, c[b], n) + np.bincount(b, c[a], n)
            up = roots(n, a, b)
            hit = np.flatnonzero(links > 0)
            out[0].append(node[group][hit])
            out[1].append(node[group][up[hit]])
            out[2].append(links[hit].astype(np.int64))
        return pa.table([np.concatenate(x) if x else np.zeros(0, np.int64) for x in out], names=["node", "up", "links"])

    verified = durable(cut.groupBy("_slot").applyInArrow(verify, "node long, up long, links long"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("up").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("_set", "node", "_copies").join(classes, "node", "left").join(links, "node", "left")
    known = known.select("_set", F.coalesce("root", "node").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    return rows.drop("_sketch").join(known, "_set", "left").select("_row", "_id", "_key", F.coalesce("_class", "_row").alias("_class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, class_id, n_links.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles (words
    are what white space separates, lower case) is 0.8 or more; n_links counts a row's linked
    rows, copies included, and class_id is the least id that links lead to. Texts of fewer than
    five words are one shingle; very long ones are whole sets; null texts and those without words
    have no links. Repeated rows link to each other. Null ids are no one's class_id unless all of a
    class are null. An empty table gives an empty table; other columns don't matter.
    """
    rows = near_duplicates(df, id_col, text_col)
    classes = rows.groupBy("_class").agg(F.min("_id").alias("class_id"))
    return rows.join(classes, "_class").select(F.col("_id").alias(id_col), "class_id", "n_links")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, whatever these are called, without near-duplicates: of each class the least id stays.

    Of rows with equal id and text but different other columns the one with the least hash stays.
    """
    rows = near_duplicates(df, id_col, text_col)
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"), F.col("_key"))
    kept = rows.groupBy("_class").agg(F.min(order).alias("_keep")).select(F.col("_keep._key").alias("_key")).distinct()
    return one_of_each(df, row_key(id_col, text_col)).join(kept, "_key", "left_semi").select("_doc.*")
