"""Curated lists that merge: ordered collections of elements that several curators add, move and remove.

An element is known by a unique tag. Adding makes a tag, removing marks the tags that the remover
had seen, so an element that was added again elsewhere meanwhile stays; last write wins could not
tell that. A tag's place is a key between those of its neighbours, and the latest move wins. A
state has one row for each tag, and merging is a union and one aggregate of maxima, so it
commutes, associates and is idempotent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.places import with_places

STATE = "collection long, tag string, item string, moved struct<version:long,curator:string,position:string>, removed boolean"
#: Digits of position keys, in the order of their bytes.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def between(low: str | None = None, high: str | None = None) -> str:
    """A position key after low and before high, None being the list's end on that side. Keys never end with the least digit, so there is always room."""
    low = low or ""
    if high is not None and not low < high or any(k and k[-1] == DIGITS[0] for k in (low, high)):
        raise ValueError(f"no position between {low!r} and {high!r}")
    out = ""
    while True:
        at = len(out)
        a = DIGITS.index(low[at]) if at < len(low) else 0
        b = DIGITS.index(high[at]) if high is not None and at < len(high) else len(DIGITS)
        if b - a > 1:
            return out + DIGITS[(a + b) // 2]
        if a != b:
            high = None  # what follows is below high whatever it is
        out += DIGITS[a]


def spread_positions(n: int, low: str | None = None, high: str | None = None) -> list[str]:
    """n position keys in order between low and high, by halves, so keys stay short."""
    if n <= 0:
        return []
    middle = between(low, high)
    return [*spread_positions((n - 1) // 2, low, middle), middle, *spread_positions(n // 2, middle, high)]


def _row(collection: Column, tag: Column, item: Column, version: Column, curator: Column, position: Column, removed: bool) -> list[Column]:
    moved = F.when(position.isNotNull(), F.struct(version.cast("long").alias("version"), curator.cast("string").alias("curator"), position.cast("string").alias("position")))
    return [collection.cast("long").alias("collection"), tag.cast("string").alias("tag"), item.cast("string").alias("item"), moved.alias("moved"), F.lit(removed).alias("removed")]


def added(edits: DataFrame) -> DataFrame:
    """A state of additions from (collection, tag, item, version, curator, position)."""
    return edits.select(*_row(*(F.col(c) for c in ("collection", "tag", "item", "version", "curator", "position")), False))


def moved(edits: DataFrame) -> DataFrame:
    """A state of moves from (collection, tag, version, curator, position)."""
    return edits.select(*_row(F.col("collection"), F.col("tag"), F.lit(None), *(F.col(c) for c in ("version", "curator", "position")), False))


def removed(seen: DataFrame) -> DataFrame:
    """A state of removals from (collection, tag): the tags that the remover had seen."""
    return seen.select(*_row(F.col("collection"), F.col("tag"), *(F.lit(None),) * 4, True))


def remove_item(state: DataFrame, collection: int, item: str) -> DataFrame:
    """The removal of an item as far as this state knows it: all its tags here, and none that is made elsewhere meanwhile."""
    return removed(state.where((F.col("collection") == collection) & (F.col("item") == item) & ~F.col("removed")))


def merge(*states: DataFrame) -> DataFrame:
    """One row for each tag: its item, its latest move (by version, then curator, then position) and whether anyone has removed it."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy("collection", "tag").agg(F.max("item").alias("item"), F.max("moved").alias("moved"), F.max("removed").alias("removed"))


def listed(state: DataFrame) -> DataFrame:
    """(collection, nth, tag, item) of the elements that are there, nth from 1 in each collection, by position, then tag.

    Removed tags, and tags whose addition hasn't arrived yet, aren't there. Rows are numbered by
    ranges of (collection, position), so a collection of any length is no task's own.
    """
    there = state.where(~F.col("removed") & F.col("item").isNotNull() & F.col("moved").isNotNull()).select("collection", F.col("moved.position").alias("position"), "tag", "item")
    placed = with_places(there, [F.asc("collection"), F.asc("position"), F.asc("tag")])
    first = placed.groupBy("collection").agg(F.min("rn").alias("_first"))
    return placed.join(first, "collection").select("collection", (F.col("rn") - F.col("_first") + 1).alias("nth"), "tag", "item")
