"""A training corpus from ``documents``: identified, deduplicated, mixed and packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet into the folder the
cluster shares and reads them again for the next, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exactdup, langid, mixing, neardup, packing, text


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, or whose language stays in doubt (posterior below a half)."""
    return langid.keep_identified(docs, public_tokenizers.path("piece_bpe_32k.model"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose texts are equal but for white space: the longest, then the smallest id."""
    return exactdup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, the smallest id; rows without an id are judged by their text."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by the calibrated probability of their source, language and topic; about 0.6 of the tokens stay."""
    return mixing.sample_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; a row for each piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models, hashes and a tokenizer decide: no SQL expresses run(), so tests hold it against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text.documents(spark, sf_dir)
    folder = f"{text.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
