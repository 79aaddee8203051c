"""What a rendered page must be before it is read: its status, its frame, and where a walk over its hashes ends."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import MIN_DESCRIBABLE

# The mark of a sandboxed frame, and the pages of a walk, by default and at most.
SANDBOX = "__sandbox"
WALK_PAGES, WALK_CAP = 12, 40
# Ms before a page can settle and until it is polled, and the text beyond which there is content.
SETTLE_AFTER, POLL_UNTIL, LEAST_TEXT = 6_000, 25_000, 40


def served(status: Column) -> Column:
    """Whether a page may be read: 2xx only; an unknown status is none."""
    return F.coalesce(status.between(200, 299), F.lit(False))


def settled(samples: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, ms, settled): when the polling of each page ends, by its recorded polls.

    samples: ms since the start, length (of the text), anchors, size (of the content region) and
    waiting (for a live connection). A poll is flat if all three sizes are those of the poll
    before, there is content, nothing thin is waited for, and the first seconds are over. Two flat
    polls in a row settle a page; else polling ends with the first poll beyond the deadline. Pages
    whose polls end before have null.
    """
    by = Window.partitionBy(page).orderBy("ms")
    same = reduce(lambda a, b: a & b, (F.coalesce(F.col(c) == F.lag(c).over(by), F.lit(False)) for c in ("length", "anchors", "size")))
    content = (F.col("length") > LEAST_TEXT) | (F.col("anchors") > 0)
    waits = (F.col("size") < MIN_DESCRIBABLE) & F.coalesce("waiting", F.lit(False))
    polls = samples.withColumn("_flat", F.coalesce(same & content & ~waits & (F.col("ms") > SETTLE_AFTER), F.lit(False)))
    polls = polls.withColumn("_still", F.col("_flat") & F.coalesce(F.lag("_flat").over(by), F.lit(False)))
    ends = polls.groupBy(page).agg(F.min(F.when(F.col("_still"), F.col("ms"))).alias("_still"), F.min(F.when(F.col("ms") > POLL_UNTIL, F.col("ms"))).alias("_late"))
    return ends.select(page, F.least("_still", "_late").alias("ms"), F.coalesce(F.col("_still") <= F.coalesce("_late", "_still"), F.lit(False)).alias("settled"))


def picked_frames(frames: DataFrame, page: str = "page_id") -> DataFrame:
    """Of each page's frames (nth, url, size) the one to read: sandboxed ones before others, then the longest, then the first."""
    best = F.max_by(F.struct("nth", "url", "size"), F.struct(F.coalesce(F.contains("url", F.lit(SANDBOX)), F.lit(False)), F.coalesce("size", F.lit(0)), -F.col("nth")))
    return frames.groupBy(page).agg(best.alias("_best")).select(page, "_best.*")


def walked(entry: str, hashes: Iterable[str | None], most: int = WALK_PAGES) -> tuple[list[str], bool]:
    """The pages of a walk, and whether it was cut short.

    The entry page is met again once without harm; a second time, or any other hash again, ends
    the walk. A page that can't be read (None) cuts it short.
    """
    pages, seen, again = [entry], set(), False
    for n, h in enumerate(hashes, 1):
        if n > min(most, WALK_CAP):
            break
        if h is None:
            return pages, True
        if h == entry:
            if again:
                break
            again = True
            continue
        if h in seen:
            break
        seen.add(h)
        pages.append(h)
    return pages, False


def walked_pages(steps: DataFrame, resource: str = "resource", most: int = WALK_PAGES) -> DataFrame:
    """(resource, pages, partial) of recorded walks: rows (resource, step, hash), step 0 is the entry. A walk has 41 steps at most."""

    @F.pandas_udf("struct<pages:array<string>,partial:boolean>")
    def walk(hashes):
        import pandas as pd

        return pd.DataFrame([walked(h[0], list(h[1:]), most) for h in hashes], columns=["pages", "partial"])

    # Nulls are cuts, so each hash stands in a struct that array_sort and collect_list keep.
    rows = steps.where(F.col("step") <= WALK_CAP).groupBy(resource).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "hash"))), lambda x: x["hash"]).alias("_hashes"))
    return rows.select(resource, walk("_hashes").alias("_w")).select(resource, "_w.*")
