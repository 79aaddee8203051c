"""Operator 3: best-fit-decreasing packing of indivisible groups into shards.

Groups (equal texts) are taken by decreasing size; each enters the shard with the tightest
remaining capacity that still holds it, found in a balanced tree of remaining capacities.
Groups of one size are interchangeable, and the tightest shard stays the tightest while it
holds more of that size, so the packing runs over a histogram of sizes.

The driver holds a row for each distinct size, not for each group: different sizes add up to the
bytes of the table, so B bytes have at most sqrt(2 B) of them. Which groups of a size go where is
told by runs of their numbers, and groups find their run by a join.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, gapless, whole

#: Runs are cut at multiples of this, so that a group meets only the runs near its number.
BLOCK = 1 << 16
#: Rows of the plan that are broadcast at most; a longer plan is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: 1024ths above the least thinkable capacity that are tried, in this order.
CAPACITIES = (*range(65), *(64 << k for k in range(1, 9)))


class RemainingTree:
    """A treap of (remaining capacity, shard), balanced by seeded priorities."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.random = random.Random(7)

    def _split(self, node, key):
        """Nodes below key, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, remaining: int, shard: int) -> None:
        low, high = self._split(self.root, (remaining, shard))
        self.root = self._join(self._join(low, [(remaining, shard), self.random.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least remaining capacity of `size` or more."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            low, high = self._split(self.root, best)
            _, high = self._split(high, (best[0], best[1] + 1))
            self.root = self._join(low, high)
        return best


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Packs (size, how many) into bins of one capacity: rows (size, first, end, bin).

    The groups of a size numbered first to end - 1 go into that bin. A group larger than the
    capacity has a bin for itself. None if more than `most` bins would be needed.
    """
    tree, bins, plan = RemainingTree(), 0, []
    for size, many in sorted(histogram, reverse=True):
        at = 0
        while at < many:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            remaining, shard = found
            n = min(many - at, remaining // size) if size else many - at
            plan.append((size, at, at + n, shard))
            tree.add(remaining - n * size, shard)
            at += n
    return plan


def least_capacity(histogram: list[tuple[int, int]], n_bins: int) -> int:
    """The first capacity for which best-fit-decreasing needs at most n_bins, by 1024ths above the mean load or the largest size."""
    least = max([-(-sum(s * n for s, n in histogram) // n_bins), *(s for s, _ in histogram)], default=0)
    for more in CAPACITIES:
        if best_fit_decreasing(histogram, capacity := least * (1024 + more) // 1024, n_bins) is not None:
            return capacity
    return least * n_bins


def cut(plan: Iterable[tuple[int, int, int, int]]) -> Iterable[tuple[int, int, int, int, int]]:
    """Rows (size, block, first, end, bin) for a plan's rows, one for each block of numbers that a row touches."""
    for size, first, end, shard in plan:
        for block in range(first // BLOCK, -(-end // BLOCK)):
            yield size, block, max(first, block * BLOCK), min(end, (block + 1) * BLOCK), shard


def pack_shards(df: DataFrame, n_shards: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows to shards; rows with equal texts stay together.

    With a capacity, as many shards of that many bytes as best-fit-decreasing needs; else the
    least capacity for which n_shards hold everything, so that loads are near equal. A size is
    the UTF-8 bytes of the text (null: none) plus 1. One row for each row of df: id, size,
    text_crc32 (null as empty), law `bytes`, shard, slot (0, 1, ... within the shard, by text
    and id) and grown_shard (null: the law isn't `key`). A group larger than the capacity has
    a shard of its own size, be it one very long text. Null or repeated ids are rows like others;
    an empty table gives an empty table; other columns don't matter.
    """
    text = whole(text_col)
    rows = durable(
        df.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_group"),
        )
    )
    groups = gapless(rows.groupBy("_group").agg(F.sum("size").alias("_size")), ["_size"], ["_group"], "_nth")
    groups = durable(groups.withColumn("_block", F.floor(F.col("_nth") / BLOCK)))
    histogram = sorted((r["_size"], r["count"]) for r in groups.groupBy("_size").count().toLocalIterator())
    if capacity is None:
        capacity = least_capacity(histogram, n_shards)
    runs = list(cut(best_fit_decreasing(histogram, capacity)))
    plan = df.sparkSession.createDataFrame(runs, "_size long, _block long, _first long, _end long, shard int")
    plan = F.broadcast(plan) if len(runs) <= BROADCAST_ROWS else plan
    dealt = groups.join(plan, ["_size", "_block"]).where("_nth >= _first AND _nth < _end").select("_group", "shard")
    placed = gapless(rows.join(dealt, "_group"), ["shard"], ["_group", "_id", "_row"], "slot")
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
