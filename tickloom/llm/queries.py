"""The training-data queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdup, langid, license, lmscore, mixing, neardup, packing, search, substring, tokencount
from .text import documents


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(documents(spark, sf_dir)).drop("spans")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = search.search(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))
    return found.withColumn("score", F.round("score", 6))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_language_id, op3_lm_scores, op4_license_scan, op5_mixing, op6_topk_search, op7_substring_dedup, op8_exact_dedup, op9_packing, op10_token_counts)
}
SQL: dict[str, str] = {"op1_near_dedup": neardup.SQL, "op6_topk_search": search.SQL, "op7_substring_dedup": substring.SQL, "op8_exact_dedup": exactdup.SQL}
