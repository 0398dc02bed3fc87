"""Registered queries of this package and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridwatch.llm import (
    bpe,
    conversations,
    decontaminate,
    exact_dedup,
    language,
    lexical,
    line_dedup,
    near_dedup,
    packing,
    quality,
    secrets,
    sharding,
    toxicity,
)
from gridwatch.llm.common import load

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_query(load(spark, sf_dir, "documents"))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(load(spark, sf_dir, "documents"), TOKENIZER)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_query(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_query(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharding_query(load(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup_query(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_query(load(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_query(load(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_query(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_hilbert_packing, op3_decontamination, op4_quality_neighbours, op5_language, op6_line_dedup,
        op7_toxicity, op8_exact_dedup, op9_sharding, op10_near_dedup, op11_byte_bpe,
        op12_conversation_repair, op13_lexical_search)}


def sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.ORACLE_SQL}
