"""From raw documents to token ids: quality rules, near duplicates, decontamination, private data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last keep the columns of docs, also others than those of documents and whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lookthru.llm import decontaminate, pieces, private_data, quality, simhash
from lookthru.llm.shared import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have under 50 words and go; null languages and sources are groups of
    their own; rows that repeat an id and a text stay or go together."""
    return quality.keep_good(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, null ids last; of rows with that id the one with the smallest
    text hash. Repeated rows leave one. Null and empty texts are duplicates of each other."""
    return simhash.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and empty texts have none and stay; repeated rows stay or go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with private data replaced by its kind; n_chars is that of the new text. Null texts stay null, and so does
    their n_chars; repeated rows each give a row."""
    return private_data.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip; one row per row. Null and empty texts have no ids."""
    return pieces.op4_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", good), ("near duplicates", single), ("decontamination", unseen), ("private data", private),
          ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, robust estimates and message passing are not SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None
