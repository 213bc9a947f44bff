"""The queries opN_<name> over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, jaccard_join, license_scan, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_files
from .common import documents, text_or_empty

#: Public vocabulary files.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_files(spark, sf_dir):
    return token_files.token_files(documents(spark, sf_dir), WORD_BPE)


@query
def op8_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_documents(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


@query
def op5_best_fit(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_weak_supervision(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    own = [F.col("_counts")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality_rules.judge(docs).select("doc_id", *own, "base_failed", "kept", "posterior")


@query
def op10_rule_ensemble(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_classifier.score(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query
def op2_histogram_sort(spark, sf_dir):
    placed = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", F.crc32(text_or_empty()).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


@query
def op6_block_naming(spark, sf_dir):
    return exact_dedup.groups(documents(spark, sf_dir)).drop("_xd_row")


ORACLE["op6_block_naming"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


@query
def op3_license_dice(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir)).select("doc_id", "license", "dice", "n_matches")


ORACLE["op3_license_dice"] = license_scan.oracle()


@query
def op3_license_windows(spark, sf_dir):
    return license_scan.scan_windows(documents(spark, sf_dir)).select("doc_id", "license", "dice", "n_matches")


@query
def op7_count_vector_tree(spark, sf_dir):
    return jaccard_join.near_duplicates(documents(spark, sf_dir), shingle=4, percent=85)


@query
def op4_sparse_bwt(spark, sf_dir):
    return substring_dedup.deduplicated(documents(spark, sf_dir), digest_only=True)
