"""A training corpus from `documents`: quality, exact copies, near copies, repeated passages, packing.

STAGES are (name, function) in order; a function takes (spark, docs, sf_dir) and returns what the next one works on, with the
columns of documents; the last returns the packed pieces. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithic.llm import exact_dedup, jaccard_join, packing, quality_classifier, queries, substring_dedup
from lithic.llm.common import cut, documents

#: Near copies: five words a shingle, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good; the labels are those of the documents still there."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.good(docs, labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.dedup(docs, SHINGLE, PERCENT)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat an earlier passage."""
    return substring_dedup.dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    pieces = packing.pack_documents(docs, queries.WORD_BPE)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", passages), ("packing", packed)]

#: Iteration, sampling and search have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, docs, sf_dir)
