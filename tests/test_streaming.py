from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import pm
from tickloom.plans import adapters as ad
from tickloom.streaming import market


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def timed(raw):
    return ad.tape(raw).withColumn("t", F.timestamp_micros("ts_us"))


def test_windows_equal_the_batch(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw.orderBy("event_id").repartitionByRange(4, "event_id").write.parquet(str(tmp_path / "e"))
    live = timed(market.read_events(spark, str(tmp_path / "e"), raw.schema))
    got = run(market.tumbling(live, "t", "60 days", "1 day", ["event_type"]), "tumbling_out", "complete")
    day = 86_400_000_000
    want = timed(raw).groupBy(F.expr(f"ts_us div {day} * {day}").alias("start_us"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repeated_reports_count_once(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw.union(raw.limit(300)).repartition(3).write.parquet(str(tmp_path / "e"))
    live = timed(market.read_events(spark, str(tmp_path / "e"), raw.schema))
    got = run(market.once(live, "t", "90 days", "seq").select("seq"), "once_out", "append")
    assert got.count() == got.distinct().count() == raw.count()


def test_streamed_books_equal_the_batch(spark, sf_dir, tmp_path):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = ad.pm_changes(raw).select("token", "seq", "px", "size", "buy").withColumn("reset", F.col("seq") % 50 == 0)
    # a reset is a row before the change of its number
    rows = changes.where("reset").union(changes.withColumn("reset", F.lit(False))).withColumn("seq", F.col("seq") * 2 + F.when(F.col("reset"), 0).otherwise(1))
    rows.orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "c"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "c"))
    told = run(market.token_books(live), "books_out", "update")
    last = told.groupBy("token").agg(F.max_by(F.struct("bid", "ask"), "seq").alias("q"))
    got = {r["token"]: (r["q"]["bid"], r["q"]["ask"]) for r in last.collect()}
    c = ad.pm_changes(raw)
    want = {r["token"]: (r["bid"], r["ask"]) for r in pm.best(pm.book(pm.seeded(c, c.where("seq % 50 = 0")))).collect()}
    assert {k: v for k, v in got.items() if v != (None, None)} == want
