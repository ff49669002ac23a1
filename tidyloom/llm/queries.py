"""One query for each operator of this package, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm import (
    contamination,
    embedding_dedup,
    hard_negatives,
    language_id,
    lexical_search,
    packing,
    quality,
    secrets,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
    warc,
)
from tidyloom.llm.common import parquet

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_identify(parquet(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(parquet(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(parquet(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(parquet(spark, sf_dir, "documents"), keyed=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository, its source for the owner."""
    return secrets.digest(secrets.scan(parquet(spark, sf_dir, "documents")))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"), keyed=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parquet(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(parquet(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeated_passages(parquet(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted_labels(parquet(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    all_ = [
        op1_language_id, op2_warc, op3_token_files, op4_simhash, op5_toxicity,
        op6_secrets, op7_contamination, op8_packing, op9_embedding_dedup, op10_quality,
        op11_lexical_search, op12_substring_dedup, op13_hard_negatives,
    ]
    return {f.__name__: f for f in all_}
