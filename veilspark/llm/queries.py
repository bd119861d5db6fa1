"""The queries of this subpackage, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe_trie, chat_format, line_dedup, lm_scoring, media_columns, packing, quality_rules, sharding, simhash, url_filters
from veilspark.llm.common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.verdicts(table(spark, sf_dir, "pages"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.group_near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_report(table(spark, sf_dir, "documents"))


def op9_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_trie.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_url_filters": op2_url_filters,
        "op3_chat_format": op3_chat_format,
        "op4_simhash": op4_simhash,
        "op5_quality_rules": op5_quality_rules,
        "op6_line_dedup": op6_line_dedup,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_media_columns": op8_media_columns,
        "op9_kd_tree_sharding": op9_kd_tree_sharding,
        "op10_bpe_trie": op10_bpe_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filters.SQL, "op5_quality_rules": quality_rules.SQL, "op6_line_dedup": line_dedup.SQL}
