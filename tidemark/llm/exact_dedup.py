"""Operator 2: exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered;
the numbers of adjacent blocks are paired, distinct pairs are sorted and numbered, and so on
until one number is left for each text. Texts with as many blocks are equal exactly when their
last numbers are equal. DataFrame functions only. A number tells a block's place among its
partition's sorted blocks and the partition, so numbering needs no second shuffle of the text.

Blocks move once, reduced to distinct ones before the shuffle. Rows find their block's number
by a 128-bit hash, which is first checked to be one to one on all distinct blocks (and reseeded
until it is), so no collision can merge two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, one_of_each, partitions, row_key, whole

BLOCK_BYTES = 8192


def _hashes(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), block).alias("_h1"), F.xxhash64(block, F.lit(seed + 1)).alias("_h2")]


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names of distinct rows, by sorting them within their partitions."""
    return distinct.sortWithinPartitions(*order).withColumn("_name", F.monotonically_increasing_id())


def document_names(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: _row (unique), id, text_sha256, _blocks (how many) and _name.

    Rows have equal texts exactly if (_blocks, _name) are equal. Null counts as empty text,
    which is one empty block.
    """
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(whole(text_col)) / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * block_bytes + 1, F.lit(block_bytes)))
    blocks = df.select(F.explode(cut).alias("_block"))
    seed = 0
    while True:
        named = durable(_numbered(blocks.select(*_hashes(F.col("_block"), seed), "_block").distinct(), ["_h1", "_h2", "_block"]).select("_h1", "_h2", "_name"))
        if named.groupBy("_h1", "_h2").count().where("count > 1").isEmpty():
            break
        seed += 2
    hashed = F.transform(cut, lambda b: F.struct(*_hashes(b, seed)))
    rows = durable(df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.sha2(whole(text_col), 256).alias("text_sha256"), count.alias("_blocks"), hashed.alias("_at")))

    at = rows.select("_row", F.posexplode("_at").alias("_pos", "_block")).select("_row", "_pos", "_block.*")
    at = at.join(named, ["_h1", "_h2"]).select("_row", "_pos", "_name")
    level = durable(_in_order(at))
    done = level.where(F.size("_names") == 1)
    while not (level := level.where(F.size("_names") > 1)).isEmpty():
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("_names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.element_at("_names", 2 * i + 1).alias("_a"), F.coalesce(F.get("_names", 2 * i + 1), F.lit(-1)).alias("_b")),
        )
        at = level.select("_row", F.posexplode(pairs).alias("_pos", "_pair")).select("_row", "_pos", "_pair.*")
        named = durable(_numbered(at.select("_a", "_b").distinct(), ["_a", "_b"]))
        level = durable(_in_order(at.join(named, ["_a", "_b"])))
        done = done.unionByName(level.where(F.size("_names") == 1))
    return rows.drop("_at").join(done.select("_row", F.element_at("_names", 1).alias("_name")), "_row")


def _in_order(at: DataFrame) -> DataFrame:
    """The names of each row's blocks in the order of the text."""
    in_order = F.array_sort(F.collect_list(F.struct("_pos", "_name")))
    return at.groupBy("_row").agg(F.transform(in_order, lambda x: x["_name"]).alias("_names"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts the one with the largest id stays; null ids count as the
    smallest, and of rows with equal id and text exactly one stays. Null and empty texts are
    equal. A very long text is as many blocks as it has, in as many rows. An empty table gives
    an empty table; other columns don't matter.
    """
    names = document_names(df, id_col, text_col, block_bytes)
    groups = names.groupBy("_blocks", "_name").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    # Kept apart from the join, whose sides can then both be split where a group is hot.
    groups = durable(groups.repartition(partitions(df.sparkSession)))
    return names.join(groups, ["_blocks", "_name"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep._id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup keeps, with all their columns, whatever these are called.

    Of rows with equal id and text but different other columns the one with the least hash stays.
    """
    found = exact_dedup(df, id_col, text_col).where("kept")
    keys = found.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("#"), "text_sha256").alias("_key"))
    return one_of_each(df, row_key(id_col, text_col)).join(keys, "_key", "left_semi").select("_doc.*")
