"""Surveillance: stuffing bursts, spoof candidates, layered orders. Thresholds and spans are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.asof import asof


def message_buckets(messages: DataFrame, bucket_us: int) -> DataFrame:
    """Messages, executions and cancels (with deletes and replaces) of each busy bucket."""
    k = F.expr(f"ts_us div {bucket_us}")
    return messages.groupBy("symbol", k.alias("bucket")).agg(
        F.count(F.lit(1)).alias("msgs"), F.count(F.when(F.col("msg_type").isin("E", "C"), 1)).alias("execs"), F.count(F.when(F.col("msg_type").isin("X", "D", "U"), 1)).alias("cancels")
    )


def islands(df: DataFrame, by: list[str], k: str) -> Column:
    """An id for each run of consecutive integers ``k`` within a group."""
    return F.col(k) - F.row_number().over(Window.partitionBy(*by).orderBy(k))


def stuffing(messages: DataFrame, bucket_us: int, min_msgs: int, rate_multiple: float, max_exec_share: float, min_cancel_share: float) -> DataFrame:
    """Runs of buckets with many messages, many cancels and few executions.

    The rate is held against the symbol's upper median over busy buckets, at least 1.
    """
    b = message_buckets(messages, bucket_us)
    w = Window.partitionBy("symbol")
    ranked = b.withColumn("r", F.row_number().over(w.orderBy("msgs"))).withColumn("n", F.count(F.lit(1)).over(w))
    ranked = ranked.withColumn("median", F.max(F.when(F.col("r") == F.expr("n div 2") + 1, F.greatest(F.col("msgs"), F.lit(1)))).over(w))
    hot = ranked.where((F.col("msgs") >= min_msgs) & (F.col("msgs") >= rate_multiple * F.col("median")) & (F.col("execs") <= max_exec_share * F.col("msgs")) & (F.col("cancels") >= min_cancel_share * F.col("msgs")))
    run = hot.withColumn("island", islands(hot, ["symbol"], "bucket"))
    return run.groupBy("symbol", "island").agg(
        (F.min("bucket") * bucket_us).alias("start_us"), ((F.max("bucket") + 1) * bucket_us).alias("end_us"), F.sum("msgs").alias("msgs"), F.sum("cancels").alias("cancels"), F.sum("execs").alias("execs"), F.round(F.max(F.col("msgs") / F.col("median")), 6).alias("rate_multiple")
    ).drop("island")


def executed_so_far(messages: DataFrame, lives: DataFrame) -> DataFrame:
    """After each execution: shares executed so far against resting bids and asks (symbol, seq, cum_B, cum_S)."""
    e = messages.where("msg_type in ('E', 'C')").select("symbol", "seq", "ref", "shares").join(lives.select("symbol", "ref", "side"), ["symbol", "ref"])
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("symbol", "seq", *[F.sum(F.when(F.col("side") == s, F.col("shares")).otherwise(0)).over(w).alias(f"cum_{s}") for s in "BS"])


def touches(lives: DataFrame, quotes: DataFrame) -> DataFrame:
    """Adds with the quote before them: whether they cross, and whether they join or better the touch."""
    q = quotes.select("symbol", "seq", "bid_px", "ask_px")
    near = asof(lives, q, on=["symbol"], left_time=F.col("add_seq"), right_time=F.col("seq"), values=["bid_px", "ask_px"], allow_equal=False)
    buy = F.col("side") == "B"
    best, other = F.when(buy, F.col("at_bid_px")).otherwise(F.col("at_ask_px")), F.when(buy, F.col("at_ask_px")).otherwise(F.col("at_bid_px"))
    crosses = F.coalesce(F.when(buy, F.col("price") >= other).otherwise(F.col("price") <= other), F.lit(False))
    touch = ~crosses & F.coalesce(F.when(buy, F.col("price") >= best).otherwise(F.col("price") <= best), F.lit(True))
    return near.withColumn("crosses", crosses).withColumn("touch", touch)


def spoofs(messages: DataFrame, lives: DataFrame, quotes: DataFrame, max_life_us: int, min_shares: int, size_multiple: float, min_opposite: int) -> DataFrame:
    """Large orders at the touch, cancelled unfilled and soon, while the other side traded.

    quotes may have ``depth``, the typical best-level size before each message (see kernels); without
    it only min_shares holds. The shares traded meanwhile are a difference of running sums, not a
    range join.
    """
    at = touches(lives.where("end_kind in ('D', 'U')"), quotes)
    if "depth" in quotes.columns:
        at = asof(at, quotes.select("symbol", "seq", "depth"), on=["symbol"], left_time=F.col("add_seq"), right_time=F.col("seq"), values=["depth"], allow_equal=False)
    else:
        at = at.withColumn("at_depth", F.lit(0.0))
    floor = F.greatest(F.lit(float(min_shares)), size_multiple * F.coalesce("at_depth", F.lit(0.0)))
    picked = at.where((F.col("executed") == 0) & (F.col("end_ts") - F.col("add_ts") <= max_life_us) & F.col("touch") & (F.col("shares") >= floor))
    cum = executed_so_far(messages, lives)
    names = ["cum_B", "cum_S"]
    a = asof(picked, cum, on=["symbol"], left_time=F.col("add_seq"), right_time=F.col("seq"), values=names, prefix="a_", allow_equal=False)
    b = asof(a, cum, on=["symbol"], left_time=F.col("end_seq"), right_time=F.col("seq"), values=names, prefix="b_", allow_equal=False)
    seen = lambda p, s: F.coalesce(F.col(f"{p}_cum_{s}"), F.lit(0))
    opposite = F.when(F.col("side") == "B", seen("b", "S") - seen("a", "S")).otherwise(seen("b", "B") - seen("a", "B"))
    return b.withColumn("opposite", opposite).where(F.col("opposite") >= min_opposite).select("symbol", "ref", "side", "price", "shares", "add_ts", "end_ts", "opposite")


def ranked(candidates: DataFrame, order: list[Column], top: int) -> DataFrame:
    return candidates.orderBy(*order).limit(top)


def summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("symbol").alias("symbols"))


def most_flagged(candidates: DataFrame, top: int = 10) -> DataFrame:
    """The symbols with most candidates; ties by symbol."""
    return candidates.groupBy("symbol").agg(F.count(F.lit(1)).alias("candidates")).orderBy(F.desc("candidates"), "symbol").limit(top)


def layers(attributed: DataFrame, burst_us: int, max_life_us: int, min_orders: int, min_levels: int, min_shares: int) -> DataFrame:
    """Bursts of one participant's orders on one side, cancelled unfilled and soon, over several levels.

    attributed: symbol, mpid, side, price, shares, add_ts, add_seq, end_ts, executed. A burst lasts a
    fixed time from its first order, so its bounds are found one after another within a participant's
    orders (kernels.bursts); the rest is an aggregation.
    """
    from tickloom.operators.kernels import bursts

    b = bursts(attributed, ["symbol", "mpid", "side"], "add_ts", "add_seq", burst_us)
    clean = b.where((F.col("executed") == 0) & F.col("end_ts").isNotNull() & (F.col("end_ts") - F.col("add_ts") <= max_life_us))
    g = clean.groupBy("symbol", "mpid", "side", "burst").agg(F.min("add_ts").alias("start_us"), F.max("end_ts").alias("end_us"), F.count(F.lit(1)).alias("orders"), F.countDistinct("price").alias("levels"), F.sum("shares").alias("shares"))
    return g.where((F.col("orders") >= min_orders) & (F.col("levels") >= min_levels) & (F.col("shares") >= min_shares))
