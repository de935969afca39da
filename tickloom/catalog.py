"""Every query of the engine by name, with the SQL that a plain database runs on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import book_queries, kernel_queries, market_queries, micro_queries, study_queries
from tickloom.plans.registry import Query

MODULES = (book_queries, micro_queries, market_queries, kernel_queries, study_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of every symbol at one moment."""
    return book_queries.l5_book_at(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.R.sql.items()}
