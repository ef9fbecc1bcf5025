"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataline.llm import fingerprint, language_id, lattice_lm, media, mixing, near_dedup, packing, quality, token_counts, url_filter
from strataline.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_config() -> packing.PackConfig:
    return packing.PackConfig(tokenizer_path("word_bpe_49k.json"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), pack_config())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.CountConfig(tokenizer_path("byte_bpe_50k.json")))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), lattice_lm.LatticeConfig(tokenizer_path("piece_bpe_32k.model")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(table(spark, sf_dir, "documents")))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_language_id, op2_near_dedup, op3_best_fit_packing, op4_token_counts, op5_lattice_lm, op6_quality, op7_mixing, op8_url_filter, op9_matroska, op10_fingerprint)
    }


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; the others are tested against brute force."""
    return {"op7_mixing": mixing.oracle()}
