"""A training-data pipeline over `documents`: five stages, each a corpus operator, written as Parquet and read again.

A null text is an empty one in every stage's decision and stays null in its column. Rows without an id are judged by their
text and never copies of another. Of rows with one id and text all stay or go together. An empty table passes through as one
without rows. Further columns of the documents are kept as they are, whatever their names, up to the last stage, which
returns doc_id, n_tokens, input_ids and mix_position. A text of any length is one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import bpe, mixing, quality, secrets, simhash
from shelfmark.llm.common import shared_dir, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near_copies(docs)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixture: by ranges of their position, so files and rows follow it."""
    return mixing.mix(docs).repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, input_ids, mix_position: files read again come in any order, so rows say their place in the mixture."""
    return bpe.encode(mixing.mix(docs), TOKENIZER, keep=("mix_position",))


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("secret_removal", secret_removal), ("mixture", mixture), ("encoding", encoding)]

#: A learned model, hashes and the tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole of `documents`."""
    docs, where = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{n}-{name}")
        docs = spark.read.parquet(f"{where}/{n}-{name}")
    return docs
