"""Results of runs as files: tables of one run, reports of prediction-market sessions, and the list of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_tables(path: str, **tables: DataFrame) -> None:
    """Each table as CSV with a header in a folder of its name."""
    for name, table in tables.items():
        table.write.option("header", "true").csv(f"{path}/{name}")


def write_run(fills: DataFrame, minutes: DataFrame, summary: DataFrame, path: str) -> None:
    write_tables(path, fills=fills, pnl_minutes=minutes, summary=summary)


def timeline(fills: DataFrame, bucket_us: int) -> DataFrame:
    """Per run and bucket of time (run, ts_us, signed, price): fills, shares, and position and cash at its end."""
    w = Window.partitionBy("run").orderBy("bucket")
    g = fills.groupBy("run", F.expr(f"ts_us div {bucket_us}").alias("bucket")).agg(
        F.count(F.lit(1)).alias("fills"), F.sum(F.abs("signed")).alias("shares"), F.sum("signed").alias("moved"), F.sum(-F.col("signed") * F.col("price")).alias("paid")
    )
    return g.select("run", "bucket", "fills", "shares", F.sum("moved").over(w).alias("position"), F.sum("paid").over(w).alias("cash"))


def filter_counts(refusals: DataFrame) -> DataFrame:
    """How often each check refused, per run (run, reason)."""
    return refusals.groupBy("run", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_session_report(fills: DataFrame, refusals: DataFrame, latencies: DataFrame, summary: DataFrame, path: str, bucket_us: int = 60_000_000) -> None:
    """A session's timeline, counts of refusals, latency histogram (low, n) and summary."""
    write_tables(path, timeline=timeline(fills, bucket_us), filters=filter_counts(refusals), latency=latencies, summary=summary)


def leaderboard(spark: SparkSession, root: str, most: int = 500) -> DataFrame:
    """The summaries of the runs in folders below a root, newest first; ties by path."""
    rows = spark.read.option("header", "true").csv(f"{root}/*/summary")
    told = rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/summary/[^/]*$", 1).alias("run_path"), F.col("_metadata.file_modification_time").alias("written"), *rows.columns)
    return told.orderBy(F.desc("written"), "run_path").limit(most)
