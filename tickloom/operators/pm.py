"""Prediction-market operators: token books from level changes, arbitrage windows, token statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FULL = 10_000  # a share's worth, in 1e-4


def seeded(changes: DataFrame, resets: DataFrame) -> DataFrame:
    """Changes after a token's last reset (snapshot) so far, which each change names as ``since``; others go."""
    both = changes.withColumn("__reset", F.lit(None).cast("long")).unionByName(resets.select("token", "seq").withColumn("__reset", F.col("seq")), allowMissingColumns=True)
    w = Window.partitionBy("token").orderBy("seq", F.col("__reset").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("since", F.last("__reset", ignorenulls=True).over(w)).where("__reset is null and since is not null").drop("__reset")


def book(changes: DataFrame) -> DataFrame:
    """Levels now: the last size told for a price, unless it is 0 or off the grid. Keeps ``since`` apart if there."""
    latest = changes.where((F.col("px") > 0) & (F.col("px") < FULL)).groupBy("token", "buy", "px").agg(F.max_by("size", "seq").alias("size"), *([F.max_by("since", "seq").alias("since")] if "since" in changes.columns else []))
    if "since" in changes.columns:
        last = changes.groupBy("token").agg(F.max("since").alias("now"))
        latest = latest.join(last, "token").where("since = now").drop("since", "now")
    return latest.where("size > 0")


def best(levels: DataFrame) -> DataFrame:
    return levels.groupBy("token").agg(F.max(F.when(F.col("buy"), F.col("px"))).alias("bid"), F.min(F.when(~F.col("buy"), F.col("px"))).alias("ask"))


def mismatches(told: DataFrame, expected: DataFrame) -> DataFrame:
    """Messages whose own best quote differs from the book's: told (token, msg, part, bid, ask), by their last part."""
    w = Window.partitionBy("token", "msg").orderBy(F.desc("part"))
    last = told.withColumn("r", F.row_number().over(w)).where("r = 1")
    e = expected.select("token", "msg", F.col("bid").alias("want_bid"), F.col("ask").alias("want_ask"))
    j = last.join(e, ["token", "msg"])
    return j.groupBy("token").agg(F.count(F.lit(1)).alias("checks"), F.count(F.when(~(F.col("bid").eqNullSafe(F.col("want_bid")) & F.col("ask").eqNullSafe(F.col("want_ask"))), 1)).alias("wrong"))


def token_totals(changes: DataFrame) -> DataFrame:
    """Per token: level changes, trades, shares and notional traded, and the span observed."""
    trade = F.col("is_trade")
    return changes.groupBy("token").agg(
        F.count(F.when(~trade, 1)).alias("deltas"), F.count(F.when(trade, 1)).alias("trades"), F.sum(F.when(trade, F.col("size")).otherwise(0)).alias("shares"),
        F.sum(F.when(trade, F.col("size") * F.col("px")).otherwise(0)).alias("notional"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"),
    )


def by_notional(totals: DataFrame, top: int) -> DataFrame:
    """The tokens that traded most by notional; ties by token."""
    return totals.orderBy(F.desc("notional"), "token").limit(top)


def time_weighted(quotes: DataFrame) -> DataFrame:
    """Spread and depth by the time each two-sided, uncrossed quote stood."""
    w = Window.partitionBy("token").orderBy("seq")
    q = quotes.withColumn("dt", F.lead("ts_us").over(w) - F.col("ts_us")).where("dt is not null and bid is not null and ask > bid")
    return q.groupBy("token").agg(F.sum("dt").alias("time_us"), F.round(F.sum((F.col("ask") - F.col("bid")) * F.col("dt")) / F.sum("dt"), 4).alias("spread"), F.round(F.sum((F.col("bid_size") + F.col("ask_size")) * F.col("dt")) / F.sum("dt"), 4).alias("depth"))


def edges(quotes: DataFrame, groups: DataFrame, legs: int) -> DataFrame:
    """After every quote of a group: what buying (or selling) all its tokens at once earns, and on how many shares.

    groups: (grp, token, leg) with legs numbered from 0. A leg without a quote so far makes the edge 0.
    """
    q = quotes.drop("grp").join(F.broadcast(groups), "token") if "grp" in quotes.columns else quotes.join(F.broadcast(groups), "token")  # a session's groups
    w = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: [F.last(F.when(F.col("leg") == k, F.col(c)), ignorenulls=True).over(w) for k in range(legs)]
    q = q.select("grp", "seq", "ts_us", *[F.array(*last(c)).alias(c) for c in ("bid", "ask", "bid_size", "ask_size")])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)  # noqa: E731  null if a leg is
    sides = F.array(
        F.struct(F.lit(True).alias("buying"), F.coalesce(FULL - total("ask"), F.lit(0)).alias("edge"), F.array_min("ask_size").alias("size")),
        F.struct(F.lit(False).alias("buying"), F.coalesce(total("bid") - FULL, F.lit(0)).alias("edge"), F.array_min("bid_size").alias("size")),
    )
    return q.select("grp", "seq", "ts_us", F.explode(sides).alias("s")).select("grp", "seq", "ts_us", "s.buying", "s.edge", "s.size")


def windows(edge: DataFrame) -> DataFrame:
    """Closed spells of positive edge: open and close time, first and largest edge, size when it was largest first."""
    w = Window.partitionBy("grp", "buying").orderBy("seq")
    on = F.col("edge") > 0
    e = edge.withColumn("on", on).withColumn("run", F.sum(F.when(on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = e.where("run > 0").groupBy("grp", "buying", "run").agg(
        F.min(F.when(F.col("on"), F.col("ts_us"))).alias("open_us"), F.min(F.when(~F.col("on"), F.struct("seq", "ts_us"))).alias("c"),
        F.min_by("edge", "seq").alias("open_edge"), F.max("edge").alias("max_edge"), F.max_by(F.when(F.col("on"), F.col("size")), F.when(F.col("on"), F.struct("edge", -F.col("seq")))).alias("size_at_max"),
    )
    return g.where("c is not null").select("grp", "buying", "open_us", F.col("c.ts_us").alias("close_us"), "open_edge", "max_edge", "size_at_max")


def window_totals(spells: DataFrame) -> DataFrame:
    """Per group: windows, buying ones, time open, the median (upper) length, and the largest edge."""
    t = spells.withColumn("len", F.col("close_us") - F.col("open_us"))
    w = Window.partitionBy("grp")
    r = t.withColumn("r", F.row_number().over(w.orderBy("len", "open_us", "buying"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.groupBy("grp").agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(F.col("buying"), 1)).alias("buying"), F.sum("len").alias("open_us"), F.max(F.when(F.col("r") == F.expr("n div 2") + 1, F.col("len"))).alias("median_us"), F.max("max_edge").alias("max_edge"))


def components(groups: list[list[int]]) -> dict[int, int]:
    """Risk groups of a session's token groups (a session holds at most some thousand tokens): token to smallest token."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for g in groups:
        for t in g[1:]:
            a, b = sorted((top(g[0]), top(t)))
            up[b] = a
    return {t: top(t) for t in list(up)}


def top_markets(markets: DataFrame, n: int) -> DataFrame:
    """The n markets of largest volume of each tag, ties by id."""
    w = Window.partitionBy("tag").orderBy(F.desc("volume"), "market")
    return markets.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
