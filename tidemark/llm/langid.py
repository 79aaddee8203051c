"""Operator 9: language identification by compression.

For each language a zstandard dictionary is made of raw training text. A text's language is
the one whose dictionary encodes the whole lower-cased text in the fewest bytes; the margin to the next
language is the score, and narrow margins are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Training documents of a language at most, and bytes of its dictionary: whole documents, by hash of the text. Longer
#: documents teach nothing.
SAMPLE_DOCS, DICTIONARY_BYTES = 96, 112_000
LEVEL = 3
#: Below this share of the second-best size the difference counts as narrow.
NARROW = 0.005


def is_held_out(id_col: str):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def first_hashes(rows: DataFrame, most: int) -> DataFrame:
    """(_lang, _hash) of the `most` least distinct hashes of each language.

    A histogram of hashes by power of two tells below which power a language has enough of them,
    so few more than `most` are put in order, however many there are.
    """
    hashes = rows.select("_lang", "_hash").distinct()
    power = F.floor(F.log2(F.col("_hash").cast("double") + F.lit(2.0**63) + 1)).cast("int")
    upto = Window.partitionBy("_lang").orderBy("_power").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashes.groupBy("_lang", power.alias("_power")).agg(F.count("*").alias("_n"))
    cut = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).where(F.col("_before") < most).groupBy("_lang").agg(F.max("_power").alias("_last"))
    first = Window.partitionBy("_lang").orderBy("_hash")
    few = hashes.join(cut, "_lang").where(power <= F.col("_last"))
    return few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("_lang", "_hash")


def learn_dictionaries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionaries by language, from a bounded sample of the documents that aren't held out.

    Two passes: hashes of texts, then the chosen texts, of which a language has SAMPLE_DOCS of
    DICTIONARY_BYTES at most. Null langs, null, empty and longer texts teach nothing.
    """
    rows = df.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.octet_length(text_col).between(1, DICTIONARY_BYTES))
    rows = rows.select(F.col(lang_col).alias("_lang"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    # As many rows as languages have samples; equal texts have equal hashes and are one training document.
    chosen = rows.sparkSession.createDataFrame([tuple(r) for r in first_hashes(rows, SAMPLE_DOCS).collect()], "_lang string, _hash long")
    texts: dict[str, dict[int, str]] = {}
    for r in rows.join(F.broadcast(chosen), ["_lang", "_hash"]).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text")).collect():
        texts.setdefault(r["_lang"], {})[r["_hash"]] = r["_text"]
    return {lang: dictionary([text for _, text in sorted(own.items())]) for lang, own in sorted(texts.items())}


def dictionary(texts: list[str]) -> bytes:
    """The lower-cased texts that fit into a dictionary, in their order."""
    parts, size = [], 0
    for text in texts:
        data = text.lower().encode("utf-8", "replace")
        if size + len(data) <= DICTIONARY_BYTES:
            parts.append(data)
            size += len(data)
    return b"\n".join(parts)


class Compressors:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.each = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang].ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is too narrow."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = text.lower().encode("utf-8", "replace")
        sizes = sorted((len(c.compress(data)), lang) for c, lang in zip(self.each, self.langs, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], min(1.0, margin), margin < NARROW


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of df: id, held_out, lang_pred, score, rejected.

    Learns from documents whose crc32(id as text) mod 4 isn't 2 and whose lang isn't null; the
    prediction sees the whole text, however long, and nothing else. `und` (score 0, rejected) if
    text is null or has no letter (Unicode categories L*), or if there is nothing to learn from. A
    null id counts as not held out. Repeated rows are predicted alike; ties go to the first language
    in code point order; an empty table gives an empty table; other columns don't matter.
    """
    small_batches(df.sparkSession)
    dictionaries = learn_dictionaries(df, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Compressors(dictionaries)
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["_id", "held_out", "lang_pred", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)
