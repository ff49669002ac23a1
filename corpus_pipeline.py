"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidyloom.llm import contamination, language_id, packing, secrets, simhash
from tidyloom.llm.common import new_folder, parquet

#: A document is rejected if no language has the greater part of the probability: what is named then is oftener wrong than right.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a recognized language; ``lang`` is replaced by the one that was found.

    The model learns from the labelled documents of two of three folds. The last stage packs by this ``lang``.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of those with the smallest identifier."""
    return simhash.keep_one(docs, simhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = parquet(spark, sf_dir, "benchmark")
    return contamination.drop_contaminated(docs, contamination.decontaminate(docs, items))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs, secrets.scan(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, each of which is of one identified language, ``lang``."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), group_col="lang").withColumnRenamed("group", "lang")


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The first stage is a trained model, the last a tokenizer with a heuristic: neither can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = parquet(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
