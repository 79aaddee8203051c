"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import oracles
from tidemark.llm.audio import audio_digest
from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.jaccard_join import jaccard_join
from tidemark.llm.langid import identify_language
from tidemark.llm.mixing import mix
from tidemark.llm.pii import find_personal_data
from tidemark.llm.quality import classify_quality
from tidemark.llm.secrets import find_secrets
from tidemark.llm.sharding import pack_shards
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.stamps import normalise_stamps
from tidemark.llm.suffix_dedup import dedup_substrings


def tokenizer() -> str:
    """The tokenizer file: what TIDEMARK_TOKENIZER names, else one of the installed public ones."""
    if named := os.environ.get("TIDEMARK_TOKENIZER"):
        return named
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digest(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_stamps(table(spark, sf_dir, "stamps"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_exact_dedup, op3_sharding, op4_mixing, op5_quality, op6_suffix_dedup, op7_pii, op8_audio, op9_langid, op10_jaccard_join, op11_spelling, op12_stamps, op13_secrets)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": oracles.EXACT_DEDUP,
        "op3_sharding": oracles.SHARDS,
        "op4_mixing": oracles.MIX,
        "op6_suffix_dedup": oracles.SUBSTRINGS,
        "op7_pii": oracles.PERSONAL_DATA,
        "op10_jaccard_join": oracles.NEAR_COPIES,
        "op11_spelling": oracles.SPELLING,
        "op12_stamps": oracles.STAMPS,
    }
