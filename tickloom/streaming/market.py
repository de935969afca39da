"""The engine's tables as Structured Streaming queries: windows with watermarks, deduplication, token books."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tickloom.session import ensure_importable


def read_events(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts and sums of ``v`` by window and keys; rows later than ``late`` are dropped, windows close by watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).select(F.unix_micros("window.start").alias("start_us"), *keys, "n", "v")


def sessions(events: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.unix_micros("session_window.start").alias("start_us"), "n")


def once(reports: DataFrame, time: str, late: str, key: str) -> DataFrame:
    """Reports that are told at least once, once each; state goes with the watermark."""
    return reports.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


BOOK = "token long, seq long, bid long, ask long"
STATE = "bids map<long, long>, asks map<long, long>, seeded boolean"


def token_books(changes: DataFrame) -> DataFrame:
    """Best quotes of a token after each micro-batch's changes (token, seq, px, size, buy, reset).

    A reset empties the book and seeds it; changes before the first reset are ignored; size 0 removes a
    level; prices off the grid are ignored. State is one token's levels.
    """
    ensure_importable(changes.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bids, asks, seeded = state.get if state.exists else ({}, {}, False)
        bids, asks = dict(bids), dict(asks)
        rows = pd.concat(list(parts)).sort_values("seq")
        for r in rows.itertuples():
            if r.reset:
                bids, asks, seeded = {}, {}, True
                continue
            if not seeded or not 0 < r.px < 10_000:
                continue
            side = bids if r.buy else asks
            if r.size:
                side[int(r.px)] = int(r.size)
            else:
                side.pop(int(r.px), None)
        state.update((bids, asks, seeded))
        yield pd.DataFrame({"token": [key[0]], "seq": [int(rows["seq"].max())], "bid": pd.array([max(bids) if bids else None], "Int64"), "ask": pd.array([min(asks) if asks else None], "Int64")})

    return changes.groupBy("token").applyInPandasWithState(step, BOOK, STATE, "update", GroupStateTimeout.NoTimeout)


def stale(heartbeats: DataFrame, time: str, after: str) -> DataFrame:
    """Spells of silence: a connection's session windows end ``after`` its last line."""
    return heartbeats.withWatermark(time, after).groupBy(F.session_window(time, after), "conn").agg(F.count(F.lit(1)).alias("lines")).select("conn", F.unix_micros("session_window.end").alias("stale_us"), "lines")


def hourly_sink(lines: DataFrame, time: str, path: str, checkpoint: str):
    """Recorded lines as files by connection and hour; the sink's log makes each batch's files count once."""
    return lines.withColumn("hour", F.date_format(time, "yyyyMMddHH")).writeStream.format("parquet").partitionBy("conn", "hour").option("path", path).option("checkpointLocation", checkpoint)
