"""Studies built on the tables of book and micro: queue value, price prediction errors, cross-impact, intensities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import market as fm


def first_fills(messages: DataFrame) -> DataFrame:
    """The first execution of each order: symbol, ref, fill_seq, fill_ts."""
    e = messages.where("msg_type in ('E', 'C')")
    return e.groupBy("symbol", "ref").agg(F.min("seq").alias("fill_seq"), F.min_by("ts_us", "seq").alias("fill_ts"))


def queue_positions(lives: DataFrame, levels: DataFrame, fills: DataFrame, edges: tuple[int, ...] = (0, 100, 300, 1000, 3000)) -> DataFrame:
    """Orders by the shares ahead when they joined: how many, how many traded, and their mean wait in seconds.

    levels: running_levels rows; the queue an add joins is its level just before.
    """
    ahead = levels.select("symbol", F.col("seq").alias("add_seq"), "side", "price", "ahead")
    joined = lives.join(ahead, ["symbol", "add_seq", "side", "price"]).join(fills, ["symbol", "ref"], "left")
    bucket = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        bucket = F.when(F.col("ahead") <= edges[k], k).otherwise(bucket)
    wait = (F.col("fill_ts") - F.col("add_ts")) / 1e6
    return joined.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("orders"), F.count("fill_seq").alias("traded"), F.round(F.avg(wait), 3).alias("mean_wait_s"))


def out_of_sample_r2(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """1 - squared error over squared deviation, of fixed predictions; null below three rows or without variance."""
    e = F.col(y) - F.col(p)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("se"), F.var_pop(y).alias("v"))
    return g.select(*by, "n", F.round(F.when((F.col("n") >= 3) & (F.col("v") > 0), 1 - F.col("se") / (F.col("v") * F.col("n"))), 6).alias("r2"))


def prediction_errors(quotes: DataFrame, g: list[float], tick: int) -> DataFrame:
    """Mean squared error of mid, weighted mid and adjusted mid against the mid after the next change, per symbol."""
    w = Window.partitionBy("symbol").orderBy("seq")
    q = quotes.withColumn("s", fm.state_of(10, 2, tick)).withColumn("mid2", fm.mid2()).where("s is not null")
    moved = q.withColumn("d", F.lag("mid2").over(w)).withColumn("at", F.when(F.col("d") != F.col("mid2"), F.col("mid2")))
    later = F.first("at", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    weighted = 2 * (F.col("bid_px") * F.col("ask_qty") + F.col("ask_px") * F.col("bid_qty")) / (F.col("bid_qty") + F.col("ask_qty"))
    adjusted = F.col("mid2") + 2 * F.element_at(F.array(*[F.lit(float(x)) for x in g]), (F.col("s") + 1).cast("int"))
    e = moved.withColumn("next2", later).where("next2 is not null")
    err = lambda x: F.round(F.avg(F.pow((x - F.col("next2")) / 2, 2)), 4)
    return e.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), err(F.col("mid2")).alias("mse_mid"), err(weighted).alias("mse_weighted"), err(adjusted).alias("mse_adjusted"))


def cross_impact(intervals: DataFrame, symbols: list[int]) -> DataFrame:
    """A row for each interval with every listed symbol's imbalance, and each symbol's next mid change.

    The list is a study's universe (some tens), which bounds the columns.
    """
    wide = intervals.groupBy("k").pivot("symbol", symbols).agg(F.first("ofi")).na.fill(0)
    named = wide.select("k", *[F.col(str(s)).alias(f"x{s}") for s in symbols])
    w = Window.partitionBy("symbol").orderBy("k")
    target = intervals.where(F.col("symbol").isin(symbols)).withColumn("next", F.lead("dmid2").over(w)).where("next is not null").select("symbol", "k", "next")
    return target.join(named, "k")


def hash_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, the same for any partitioning: those of smallest key hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def latency_histogram(df: DataFrame, x: str, bits: int = 4) -> DataFrame:
    """Log-linear buckets: 2^bits steps within each power of two; (low, n). Histograms merge by adding counts."""
    v = F.col(x).cast("long")
    shift = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))) - bits, F.lit(0)).cast("int")
    low = F.expr(f"shiftleft(shiftright({x}, __s), __s)")
    return df.where(F.col(x).isNotNull()).withColumn("__s", shift).groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("n"))


def sweep_totals(runs: DataFrame, params: list[str]) -> DataFrame:
    return runs.groupBy(*params).agg(F.count(F.lit(1)).alias("runs"), F.sum("total").alias("total"), F.sum("fills").alias("fills")).orderBy(F.desc("total"), *params)


BINS = 32


def fit_intensity(exposure: dict[int, float], fills: dict[int, float], a0: float = 1.0, k0: float = 0.1, prior: float = 1.0, width: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """(A, k) of a fill rate A e^(-k distance) by Poisson likelihood, by Newton steps.

    Takes exposure time and fills by distance bin, which an aggregation gives. Every one of the bins
    also has ``prior`` seconds of exposure at the rate that (a0, k0) give, so bins without data count.
    """
    d = (np.arange(BINS) + 0.5) * width
    t = np.array([exposure.get(b, 0.0) for b in range(BINS)]) + prior
    n = np.array([fills.get(b, 0.0) for b in range(BINS)]) + prior * a0 * np.exp(-k0 * d)
    la, k = math.log(a0), k0
    for _ in range(rounds):
        rate = t * np.exp(la - k * d)
        grad = np.array([(n - rate).sum(), (d * (rate - n)).sum()])
        hess = np.array([[rate.sum(), -(d * rate).sum()], [-(d * rate).sum(), (d * d * rate).sum()]])
        if np.linalg.det(hess) <= 0:
            break
        step = np.clip(np.linalg.solve(hess, grad), [-1.0, -0.5], [1.0, 0.5])
        la, k = la + step[0], min(max(k + step[1], 1e-3), 10.0)
        if float(np.abs(step).max()) < 1e-10:
            break
    return math.exp(la), float(k)


def intensity_bins(orders: DataFrame, width: float = 1.0, age: str | None = None, memory: float = 600.0) -> DataFrame:
    """Exposure and fills by distance bin of (distance, exposed, filled) rows; with an age, both fade by e^(-age / memory)."""
    b = F.greatest(F.least(F.floor(F.col("distance") / width), F.lit(BINS - 1)), F.lit(0)).cast("int")
    w = F.exp(-F.col(age) / memory) if age else F.lit(1.0)
    return orders.groupBy(b.alias("bin")).agg(F.sum(F.col("exposed") * w).alias("exposure"), F.sum(F.col("filled").cast("double") * w).alias("fills"))
