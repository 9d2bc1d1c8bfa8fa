"""Queries of the operators over the given tables: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lookthru.llm import (decontaminate, divergence, hosts, jaccard, main_text, passages, pieces, private_data, quality, resampling,
                          simhash, token_counts, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1_quality(_table(spark, sf_dir, "documents"))


def op2_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.op2_private_data(_table(spark, sf_dir, "documents"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.op3_hosts(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op4_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op4_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op5_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_simhash(_table(spark, sf_dir, "documents"))


def op7_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.op8_main_text(_table(spark, sf_dir, "pages"))


def op9_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.op9_passages(_table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10_winnowing(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op11_divergence(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.op12_resampling(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_jaccard_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op13_jaccard(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_mcd, op2_skip_chain_crf, op3_host_reputation, op4_streaming_viterbi, op5_token_counts,
    op6_simhash_links, op7_cnn_toxicity, op8_tree_scoring, op9_shared_passages,
    op10_winnowing, op11_source_divergence, op12_importance_resampling,
    op13_jaccard_partenum)}

ORACLE: dict[str, str] = {"op10_winnowing": decontaminate.ORACLE, "op11_source_divergence": divergence.ORACLE,
                          "op12_importance_resampling": resampling.ORACLE, "op13_jaccard_partenum": jaccard.ORACLE}
