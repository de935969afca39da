"""Quote and trade estimators: windows over (symbol order by seq), intervals, as-of joins, small fits.

Every horizon, interval and threshold is a parameter in microseconds. Integer forms (twice the mid)
are kept until a result needs a ratio.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import market as fm
from tickloom.operators.asof import asof, grid


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("seq")


def so_far() -> Window:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def session(df: DataFrame, start_us: int, end_us: int, day_us: int = 86_400_000_000) -> DataFrame:
    """Rows whose time of day lies in [start, end)."""
    at = F.col("ts_us") % day_us
    return df.where((at >= start_us) & (at < end_us))


def trading_state(df: DataFrame, state: Column) -> DataFrame:
    """The state in force at each row: the last one told, 'T' before any."""
    return df.withColumn("state", F.coalesce(F.last(state, ignorenulls=True).over(so_far()), F.lit("T")))


def changed_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes that differ from the one before."""
    now = F.struct("bid_px", "bid_qty", "ask_px", "ask_qty")
    return quotes.withColumn("__same", now.eqNullSafe(F.lag(now).over(by_symbol()))).where(~F.col("__same")).drop("__same")


def ofi_events(quotes: DataFrame) -> DataFrame:
    """The imbalance of each quote after its predecessor; an invalid quote on either side gives none."""
    names = ("bid_px", "bid_qty", "ask_px", "ask_qty")
    now, last = [F.col(c) for c in names], [F.lag(c).over(by_symbol()) for c in names]
    ok = fm.valid_quote() & F.coalesce(F.lag(fm.valid_quote()).over(by_symbol()), F.lit(False))
    return quotes.select("symbol", "seq", "ts_us", fm.mid2().alias("mid2"), (F.col("bid_qty") + F.col("ask_qty")).alias("depth2"), F.when(ok, fm.ofi(*now, *last)).alias("ofi"))


def ofi_intervals(quotes: DataFrame, every_us: int) -> DataFrame:
    """Per interval: imbalance, change of twice the mid since the interval began, and mean depth.

    Intervals without quotes have no imbalance and no change and carry the last depth on.
    """
    e = ofi_events(quotes).withColumn("k", F.expr(f"ts_us div {every_us}"))
    part = e.groupBy("symbol", "k").agg(F.sum(F.coalesce("ofi", F.lit(0))).alias("ofi"), F.max_by("mid2", "seq").alias("last2"), F.sum("depth2").alias("depth_sum"), F.count(F.lit(1)).alias("n"))
    ends = part.groupBy("symbol").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    every = grid(ends, on=["symbol"], start="a", end="b", step=1).withColumnRenamed("g", "k")
    w = Window.partitionBy("symbol").orderBy("k")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(part, ["symbol", "k"], "left").withColumn("mid2", F.last("last2", ignorenulls=True).over(back))
    start = F.coalesce(F.lag("mid2").over(w), F.col("mid2"))
    depth = F.last(F.col("depth_sum") / (2 * F.col("n")), ignorenulls=True).over(back)
    return full.select("symbol", "k", F.coalesce("ofi", F.lit(0)).alias("ofi"), (F.col("mid2") - start).alias("dmid2"), F.round(depth, 6).alias("depth"))


def regression(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """Least squares of y on x by group: slope, intercept, R2; zeros where it has no meaning."""
    fit = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("__vx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    ok = (F.col("n") >= 3) & (F.col("__vx") > 0)
    return fit.select(*by, "n", *[F.round(F.when(ok & F.col(c).isNotNull(), F.col(c)).otherwise(0.0), 6).alias(c) for c in ("slope", "intercept", "r2")])


def second_grid(quotes: DataFrame, step_us: int) -> DataFrame:
    """Twice the mid at each grid time within a symbol's life (quotes at the time itself count)."""
    ends = quotes.groupBy("symbol").agg(F.expr(f"(min(ts_us) div {step_us} + 1) * {step_us}").alias("a"), F.expr(f"max(ts_us) div {step_us} * {step_us}").alias("b")).where("a <= b")
    times = grid(ends, on=["symbol"], start="a", end="b", step=step_us)
    return asof(times, quotes.withColumn("mid2", fm.mid2()), on=["symbol"], left_time=F.col("g"), right_time=F.col("ts_us"), values=["mid2"], prefix="")


def volatility_signature(gridded: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """Realised variance per step at each lag, over all overlapping returns."""
    w = Window.partitionBy("symbol").orderBy("g")
    out = None
    for k in lags:
        r = gridded.withColumn("r", F.log(F.col("mid2") / F.lag("mid2", k).over(w)))
        one = r.groupBy("symbol").agg(F.round(F.sum(F.col("r") * F.col("r")) / k * 1e6, 6).alias("rv")).select("symbol", F.lit(k).cast("long").alias("lag"), "rv")
        out = one if out is None else out.unionByName(one)
    return out


def transitions(quotes: DataFrame, tick: int) -> DataFrame:
    """Counts of moves between the 20 states (10 imbalance buckets, spreads of 1 and 2 ticks) with the
    change of twice the mid, each counted again mirrored, so the table is symmetric."""
    s = quotes.withColumn("to", fm.state_of(10, 2, tick)).withColumn("mid2", fm.mid2()).where("to is not null")
    s = s.withColumn("from", F.lag("to").over(by_symbol())).withColumn("d2", F.col("mid2") - F.lag("mid2").over(by_symbol())).where("from is not null")
    s = s.where((F.col("from") != F.col("to")) | (F.col("d2") != 0))
    flip = lambda c: (9 - F.col(c) % 10) + 10 * F.expr(f"`{c}` div 10")
    both = s.select("from", "to", "d2").union(s.select(flip("from"), flip("to"), -F.col("d2")))
    return both.groupBy("from", "to", "d2").agg(F.count(F.lit(1)).alias("n"))


def micro_price(counts: DataFrame, terms: int = 8) -> list[float]:
    """G of each of the 20 states: the expected change of the mid after the next ``terms`` mid changes.

    counts: (from, to, d2, n), at most a few thousand rows. Q: moves that keep the mid; T: moves that
    change it; R: the changes themselves. G is R's expectation at the first change, carried on by T.
    """
    q, t, r = np.zeros((20, 20)), np.zeros((20, 20)), np.zeros(20)
    for row in counts.collect():
        if row["d2"] == 0:
            q[row["from"], row["to"]] += row["n"]
        else:
            t[row["from"], row["to"]] += row["n"]
            r[row["from"]] += row["n"] * row["d2"] / 2
    total = q.sum(axis=1) + t.sum(axis=1)
    safe = np.maximum(total, 1)
    q, t, r = q / safe[:, None], t / safe[:, None], r / safe
    solve = np.linalg.pinv(np.eye(20) - q)
    step, g = solve @ r, np.zeros(20)
    carry = solve @ t
    for _ in range(terms):
        g += step
        step = carry @ step
    return g.tolist()


def intraday_medians(quotes: DataFrame, bin_us: int, day_us: int = 86_400_000_000) -> DataFrame:
    """Median over symbol-days of the mean spread, by time of day."""
    at = F.expr(f"(ts_us % {day_us}) div {bin_us}")
    one = quotes.groupBy("symbol", F.expr(f"ts_us div {day_us}").alias("day"), at.alias("w")).agg(F.avg(F.col("ask_px") - F.col("bid_px")).alias("spread"))
    return one.groupBy("w").agg(F.round(F.median("spread"), 6).alias("median_spread"), F.count(F.lit(1)).alias("n"))


def eta(quotes: DataFrame) -> DataFrame:
    """Continuations and alternations of the mid's direction, and their ratio's half."""
    m = quotes.withColumn("d", fm.mid2() - F.lag(fm.mid2()).over(by_symbol())).where("d <> 0").withColumn("s", F.signum("d"))
    m = m.withColumn("last", F.lag("s").over(by_symbol())).where("last is not null")
    out = m.groupBy("symbol").agg(F.count(F.when(F.col("s") == F.col("last"), 1)).alias("same"), F.count(F.when(F.col("s") != F.col("last"), 1)).alias("turned"))
    return out.withColumn("eta", F.round(F.when(F.col("turned") > 0, F.col("same") / (2 * F.col("turned"))), 6))


def moments(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Mean, sample deviation, skewness and (not excess) kurtosis."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.round(F.skewness(x), 5).alias("skew"), F.round(F.kurtosis(x) + 3, 5).alias("kurt"))


def autocorrelation(df: DataFrame, x: str, by: str, order: str, lag: int) -> DataFrame:
    """Sum of products with the lagged value over the sum of squares, both about the whole sample's mean."""
    w = Window.partitionBy(by)
    d = df.withColumn("d", F.col(x) - F.avg(x).over(w)).withColumn("back", F.lag("d", lag).over(w.orderBy(order)))
    return d.groupBy(by).agg(F.round(F.when(F.sum(F.col("d") * F.col("d")) > 0, F.sum(F.col("d") * F.col("back")) / F.sum(F.col("d") * F.col("d"))), 5).alias("acf"))


def upper_median(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """The element at index n div 2 of the sorted values; ranks are made in windows, not arrays."""
    w = Window.partitionBy(*by)
    r = df.where(F.col(x).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(x))).withColumn("__n", F.count(F.lit(1)).over(w))
    return r.where(F.col("__r") == F.expr("__n div 2") + 1).select(*by, F.col(x).alias("upper_median"))


def markov_moves(quotes: DataFrame, buckets: int, spreads: int, tick: int, split_us: int) -> DataFrame:
    """Each quote's state, the one before, the mid's direction, the time spent before, and its period."""
    s = quotes.withColumn("state", fm.capped_state(buckets, spreads, tick)).withColumn("mid2", fm.mid2())
    s = s.withColumn("before", F.lag("state").over(by_symbol())).withColumn("up", F.signum(F.col("mid2") - F.lag("mid2").over(by_symbol())).cast("long")).withColumn("held", F.col("ts_us") - F.lag("ts_us").over(by_symbol()))
    return s.where("before is not null and state is not null").select("symbol", "seq", "before", "state", "up", "held", (F.col("ts_us") < split_us).alias("fit"))


def markov_table(moves: DataFrame) -> DataFrame:
    """Transitions and time spent over all, and directions over the fit period, by states."""
    return moves.groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held"), F.count(F.when(F.col("fit") & (F.col("up") > 0), 1)).alias("ups"), F.count(F.when(F.col("fit") & (F.col("up") < 0), 1)).alias("downs"))


def markov_score(moves: DataFrame) -> DataFrame:
    """Out of sample: moves, hits of the fitted majority by state (a tie is a miss), and of the majority overall."""
    seen = moves.where("fit and up <> 0").groupBy("before").agg(F.count(F.when(F.col("up") > 0, 1)).alias("ups"), F.count(F.when(F.col("up") < 0, 1)).alias("downs"))
    test = moves.where("not fit and up <> 0").join(seen, "before", "left")
    guess = F.signum(F.coalesce("ups", F.lit(0)) - F.coalesce("downs", F.lit(0)))
    return test.agg(F.count(F.lit(1)).alias("moves"), F.count(F.when(guess == F.col("up"), 1)).alias("hits"), F.greatest(F.count(F.when(F.col("up") > 0, 1)), F.count(F.when(F.col("up") < 0, 1))).alias("baseline"))


def marked_trades(trades: DataFrame, quotes: DataFrame, horizon_us: int) -> DataFrame:
    """Trades with twice the mid in force before ts + horizon (a quote at that very time does not count)."""
    later = quotes.select("symbol", "seq", "ts_us", fm.mid2().alias("mid2"))
    out = asof(trades, later, on=["symbol"], left_time=F.col("ts_us") + horizon_us, right_time=F.col("ts_us"), values=["mid2"], prefix="later_", allow_equal=False)
    last = quotes.groupBy("symbol").agg(F.max("ts_us").alias("data_end"))
    out = out.join(last, "symbol").withColumn("resolved", F.col("ts_us") + horizon_us <= F.col("data_end"))
    return out.drop("data_end")


def trade_costs(marked: DataFrame, day_us: int = 86_400_000_000) -> DataFrame:
    """Share-weighted effective and realised spread and impact, in 1e-4 of the mid, by day and size."""
    m = marked.where("resolved and not hidden").withColumn("m2", F.col("bid_px") + F.col("ask_px")).withColumn("size", fm.size_bucket())
    bp = lambda num: F.col("shares") * F.col("dir") * num / F.col("m2") * 1e4
    g = m.groupBy(F.expr(f"ts_us div {day_us}").alias("day"), "size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.sum(bp(2 * F.col("price") - F.col("m2"))).alias("e"), F.sum(bp(2 * F.col("price") - F.col("later_mid2"))).alias("r"), F.sum(bp(F.col("later_mid2") - F.col("m2"))).alias("i")
    )
    return g.select("day", "size", "n", "shares", *[F.round(F.col(c) / F.col("shares"), 4).alias(name) for c, name in (("e", "effective"), ("r", "realized"), ("i", "impact"))])


def best_execution(marked: DataFrame) -> DataFrame:
    """Execution sums in half 1e-4 dollars by symbol and size, with totals by symbol and over all.

    Executions, shares and the effective spread count at once, the rest when the markout resolves;
    hidden prints inside the quote improve on the touch they were signed against.
    """
    m2 = F.col("bid_px") + F.col("ask_px")
    seen, hid, done = ~F.col("hidden"), F.col("hidden") & (F.col("price") > F.col("bid_px")) & (F.col("price") < F.col("ask_px")), F.col("resolved") & ~F.col("hidden")
    side = fm.trade_sign()
    improved = F.when(side > 0, 2 * (F.col("ask_px") - F.col("price"))).when(side < 0, 2 * (F.col("price") - F.col("bid_px"))).otherwise(F.col("ask_px") - F.col("bid_px"))
    put = lambda test, x: F.sum(F.when(test, x).otherwise(0))
    rolled = marked.withColumn("size", fm.size_bucket()).rollup("symbol", "size").agg(
        put(seen, F.lit(1)).alias("execs"), put(seen, F.col("shares")).alias("shares"),
        put(seen, F.col("shares") * F.col("dir") * (2 * F.col("price") - m2)).alias("effective"),
        put(done, F.col("shares") * F.col("dir") * (2 * F.col("price") - F.col("later_mid2"))).alias("realized"),
        put(done, F.col("shares") * F.col("dir") * (F.col("later_mid2") - m2)).alias("impact"),
        put(hid, F.col("shares")).alias("hidden_shares"), put(hid, F.col("shares") * improved).alias("improved"),
    )
    return rolled.select(F.coalesce(F.col("symbol").cast("string"), F.lit("all")).alias("symbol"), F.coalesce("size", F.lit("all")).alias("size"), "execs", "shares", "effective", "realized", "impact", "hidden_shares", "improved")


def volume_buckets(trades: DataFrame, volume: int) -> DataFrame:
    """Buckets of equal volume; a trade is split over the buckets it spans. Only full buckets are given."""
    cum = F.sum("shares").over(so_far())
    t = trades.withColumn("hi", cum).withColumn("lo", F.col("hi") - F.col("shares"))
    parts = t.withColumn("b", F.explode(F.sequence(F.expr(f"lo div {volume}"), F.expr(f"(hi - 1) div {volume}"))))
    part = F.least(F.col("hi"), (F.col("b") + 1) * volume) - F.greatest(F.col("lo"), F.col("b") * volume)
    g = parts.groupBy("symbol", "b").agg(F.sum(part).alias("vol"), F.sum(part * F.col("dir")).alias("net"), F.max_by(F.col("bid_px") + F.col("ask_px"), "seq").alias("mid2"))
    return g.where(F.col("vol") == volume).select("symbol", F.col("b").alias("bucket"), F.abs("net").alias("abs_net"), "mid2")


def vpin(buckets: DataFrame, volume: int, window: int) -> DataFrame:
    """Mean imbalance of the last ``window`` buckets, from the bucket that has so many before it."""
    w = Window.partitionBy("symbol").orderBy("bucket")
    v = buckets.withColumn("s", F.sum("abs_net").over(w.rowsBetween(1 - window, 0))).withColumn("i", F.row_number().over(w) - 1)
    return v.where(F.col("i") >= window).select("symbol", "bucket", F.round(F.col("s") / (window * volume), 6).alias("vpin"))


def mid_moves(quotes: DataFrame) -> DataFrame:
    """Changes of the mid: symbol, seq, ts_us, up."""
    d = fm.mid2() - F.lag(fm.mid2()).over(by_symbol())
    return quotes.withColumn("d", d).where("d <> 0").select("symbol", "seq", "ts_us", F.signum("d").cast("long").alias("up"))


def lead_lag(moves: DataFrame, pairs: DataFrame, horizon_us: int, shift_us: int = 0) -> DataFrame:
    """For each pair (leader, follower): leads, leads answered within the horizon, and alike.

    A leader's move is answered by the follower's first move strictly after it (plus a shift, for a
    placebo). Counting ends at the first lead with no later follower move.
    """
    lead = pairs.join(moves.select(F.col("symbol").alias("leader"), F.col("seq").alias("lead_seq"), "ts_us", "up"), "leader")
    follow = pairs.select(F.col("leader").alias("l"), F.col("follower").alias("f")).join(moves.select(F.col("symbol").alias("f"), "seq", F.col("ts_us").alias("t"), F.col("up").alias("answer")), "f").select(F.col("l").alias("leader"), F.col("f").alias("follower"), "seq", "t", "answer")
    near = asof(lead, follow, on=["leader", "follower"], left_time=F.col("ts_us") + shift_us, right_time=F.col("t"), values=["answer"], prefix="", forward=True, allow_equal=False, keep_time="t")
    counted = near.where("t is not null")
    ok = F.col("t") - F.col("ts_us") - shift_us <= horizon_us
    return counted.groupBy("leader", "follower").agg(F.count(F.lit(1)).alias("leads"), F.count(F.when(ok, 1)).alias("answered"), F.count(F.when(ok & (F.col("answer") == F.col("up")), 1)).alias("same"))


def depth_levels(quotes: DataFrame, bids: Column, asks: Column) -> DataFrame:
    """A row for each level of arrays of (px, qty), best first: symbol, seq, ts_us, level, bid and ask of it."""
    return quotes.select("symbol", "seq", "ts_us", F.posexplode(F.arrays_zip(bids.alias("b"), asks.alias("a"))).alias("level", "x")).select("symbol", "seq", "ts_us", F.col("level").cast("long").alias("level"), F.col("x.b.px").alias("bid_px"), F.col("x.b.qty").alias("bid_qty"), F.col("x.a.px").alias("ask_px"), F.col("x.a.qty").alias("ask_qty"))


def mlofi(levels: DataFrame, every_us: int) -> DataFrame:
    """Imbalance of each level over each interval; a missing ask counts as infinitely dear, a missing bid as 0."""
    w = Window.partitionBy("symbol", "level").orderBy("seq")
    full = levels.withColumn("ask_px", F.coalesce("ask_px", F.lit((1 << 62)))).withColumn("bid_px", F.coalesce("bid_px", F.lit(0))).fillna(0, ["bid_qty", "ask_qty"])
    names = ("bid_px", "bid_qty", "ask_px", "ask_qty")
    e = full.withColumn("e", fm.ofi(*[F.col(c) for c in names], *[F.lag(c).over(w) for c in names]))
    return e.groupBy("symbol", F.expr(f"ts_us div {every_us}").alias("k"), "level").agg(F.sum(F.coalesce("e", F.lit(0))).alias("ofi"))


def level_covariance(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Population covariances of the columns: one row, one aggregate for each pair."""
    return wide.agg(*[F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]])


def first_component(wide: DataFrame, columns: list[str]) -> tuple[list[float], float]:
    """Weights (absolute sum 1) and variance share of the first principal component; the matrix is small."""
    row = level_covariance(wide, columns).first()
    n = len(columns)
    m = np.zeros((n, n))
    for i, a in enumerate(columns):
        for j in range(i, n):
            m[i, j] = m[j, i] = row[f"{a}_{columns[j]}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    v = vectors[:, -1]
    v = v * np.sign(v.sum() or 1.0)
    return (v / max(np.abs(v).sum(), 1e-300)).tolist(), float(values[-1] / max(values.sum(), 1e-300))


def ridge(df: DataFrame, xs: list[str], y: str, penalty: float = 1.0) -> list[float]:
    """Intercept (not penalised) and coefficients, from sums of products over the cluster."""
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    sums = df.agg(*[F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j >= i], *[F.sum(a * F.col(y)).alias(f"y{i}") for i, a in enumerate(terms)]).first()
    n = len(terms)
    m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    m[np.arange(1, n), np.arange(1, n)] += penalty
    return np.linalg.solve(m, np.array([sums[f"y{i}"] or 0.0 for i in range(n)])).tolist()


def total_variation(ref: DataFrame, other: DataFrame, x: str, bins: int) -> DataFrame:
    """Total variation between two samples over bins at the pooled quantiles (equal edges merged)."""
    pooled = ref.select(F.lit(0).alias("s"), F.col(x).alias("x")).union(other.select(F.lit(1), F.col(x)))
    edges = pooled.agg(F.array_distinct(F.percentile("x", F.array(*[F.lit(k / bins) for k in range(1, bins)]))).alias("edges"))
    n = pooled.crossJoin(F.broadcast(edges)).select("s", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin"))  # edges: one row
    part = n.groupBy("bin").agg(F.count(F.when(F.col("s") == 0, 1)).alias("a"), F.count(F.when(F.col("s") == 1, 1)).alias("b"))
    total = part.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.collect_list(F.struct("a", "b")).alias("rows"))
    return total.select(F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + F.abs(r["a"] / F.col("na") - r["b"] / F.col("nb"))) / 2, 6).alias("tv"))


def wasserstein(ref: DataFrame, other: DataFrame, x: str, points: int) -> DataFrame:
    """Mean distance of the two samples' quantiles, in units of the reference's deviation."""
    at = F.array(*[F.lit((k + 0.5) / points) for k in range(points)])
    a = ref.agg(F.percentile(x, at).alias("qa"), F.stddev_samp(x).alias("sd"))
    b = other.agg(F.percentile(x, at).alias("qb"))
    d = F.aggregate(F.zip_with("qa", "qb", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v) / points
    return a.crossJoin(b).select(F.round(F.when(F.col("sd") > 0, d / F.col("sd")), 6).alias("w1"))  # one row each
