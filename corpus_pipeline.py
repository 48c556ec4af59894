"""Corpus pipeline: from raw documents to encoded ones.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and its output is written and read
again before the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinepair.llm import exact_dedup, mixing, near_copies, quality_classifier, sentence_pieces
from kinepair.sources.staging import release, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from the labels, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.accepted(docs, quality_classifier.train(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of equal texts."""
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each component of texts that share 0.8 of their five-word shingles."""
    return near_copies.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the budget tree, once for each epoch."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left."""
    found = sentence_pieces.encode(docs)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def begun(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, begun without what the one before left on the driver."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("quality_classifier", begun(quality)), ("exact_dedup", begun(exact)), ("simhash_near_dedup", begun(near)), ("mixing", begun(mix)),
          ("sentence_pieces", begun(encode))]

#: Fitted models and encoding are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
