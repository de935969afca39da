"""Queries whose operators are sequential folds, with SQL where a relational twin exists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import kernels, pm_exec, sim
from tickloom.plans import adapters as ad
from tickloom.plans.registry import Registry
from tickloom.sources import flows, itch

R = Registry()


def _messages(spark, sf_dir):
    return ad.messages(ad.bbo(ad.events(spark, sf_dir)))


TWIN = "pts as (select distinct symbol, seq from messages), d as (select symbol, seq, side, price, sum(dqty) as dqty from deltas group by all), lv as (select p.symbol, p.seq, d.side, d.price, sum(d.dqty) as qty from pts p join d on p.symbol = d.symbol and d.seq <= p.seq group by all having sum(d.dqty) > 0)"


@R.add(ad.sql(f"with {TWIN} select p.symbol, p.seq, max(case when side = 'B' then price end) as bid_px, cast(arg_max(qty, price) filter (side = 'B') as bigint) as bid_qty, min(case when side = 'S' then price end) as ask_px, cast(arg_min(qty, price) filter (side = 'S') as bigint) as ask_qty from pts p left join lv on p.symbol = lv.symbol and p.seq = lv.seq group by p.symbol, p.seq", "deltas"))
def l3_best_quotes(spark, sf_dir):
    return kernels.sweep(_messages(spark, sf_dir)).select("symbol", "seq", "bid_px", "bid_qty", "ask_px", "ask_qty")


@R.add(ad.sql(f"with {TWIN}, r as (select *, row_number() over (partition by symbol, seq, side order by case side when 'B' then -price else price end) as l from lv) select symbol, seq, side, cast(l as bigint) as level, price as px, cast(qty as bigint) as qty from r where l <= 3", "deltas"))
def l9_depth_after_each_message(spark, sf_dir):
    d = kernels.depth_sweep(_messages(spark, sf_dir), 3)
    side = lambda s, c: d.select("symbol", "seq", F.lit(s).alias("side"), F.posexplode(c).alias("l", "x"))
    return side("B", "bids").union(side("S", "asks")).select("symbol", "seq", "side", (F.col("l") + 1).cast("long").alias("level"), F.col("x.px").alias("px"), F.col("x.qty").alias("qty"))


@R.add(ad.sql("with recursive e as (select symbol, seq, v, row_number() over (partition by symbol order by seq) as r from tape), w as (select symbol, seq, r, cast(v as double) as x from e where r = 1 union all select e.symbol, e.seq, e.r, 0.9 * w.x + (1 - 0.9) * e.v from w join e on e.symbol = w.symbol and e.r = w.r + 1) select symbol, seq, round(x + 1.234567e-7, 4) as ewma from w", "tape").replace("with tape", "with recursive tape").replace(", recursive e as", ", e as"))
def w8_decayed_average(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir)).select("symbol", "seq", F.col("v").cast("double").alias("v"))
    return kernels.ewma(t, ["symbol"], ["seq"], "v", 0.9).select("symbol", "seq", F.round(F.col("v_ewma") + 1.234567e-7, 4).alias("ewma"))


@R.add()
def e18_features(spark, sf_dir):
    q = ad.bbo(ad.events(spark, sf_dir))
    kind = F.when(F.col("event_type") == "purchase", F.when(F.col("seq") % 5 == 0, "hidden").otherwise("trade")).when(F.col("event_type") == "error", "cancel").otherwise("add")
    rows = q.withColumn("kind", kind).withColumn("dir", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)).withColumn("shares", F.col("v") + 1)
    out = kernels.features(rows, fast_us=6 * 3.6e9, slow_us=2 * 8.64e10)
    return out.select("symbol", "seq", *[F.round(f, 6).alias(f) for f in kernels.FEATURES])


@R.add()
def e19_cross_asset_momentum(spark, sf_dir):
    from tickloom.operators.asof import asof

    q = ad.bbo(ad.events(spark, sf_dir))
    rows = q.withColumn("kind", F.lit("add")).withColumn("dir", F.lit(0)).withColumn("shares", F.lit(0).cast("long"))
    m = kernels.features(rows, fast_us=6 * 3.6e9, slow_us=2 * 8.64e10).select("symbol", "seq", "ts_us", "momentum_fast")
    lead = m.select((F.col("symbol") + 10).alias("symbol"), "seq", "ts_us", "momentum_fast")
    follow = m.select("symbol", "seq", "ts_us")  # each symbol follows the one ten before it
    near = asof(follow, lead, on=["symbol"], left_time=F.col("ts_us"), right_time=F.col("ts_us"), values=["momentum_fast"], prefix="lead_", keep_time="lead_us")
    return near.select("symbol", "seq", F.round(F.col("lead_momentum_fast") * F.exp(-(F.col("ts_us") - F.col("lead_us")) / F.lit(6 * 3.6e9)) * 1e4, 6).alias("lead_bp"))


@R.add()
def e9_self_excitation(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    week = 7 * 86_400_000_000
    times = t.select((F.col("symbol") % 5).alias("pool"), F.expr(f"ts_us div {week}").alias("week"), ((F.col("ts_us") % week) / 1e6).alias("t"))
    out = kernels.hawkes(times, ["pool", "week"], 50, week / 1e6)
    return out.select("pool", "week", "n", F.round("branching", 4).alias("branching"))


@R.add()
def w22_throttled(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    return kernels.throttle(t, ["symbol"], "ts_us", "seq", 1 / 86_400, 2).select("symbol", "seq", "admitted")


@R.add()
def e25_block_bootstrap(spark, sf_dir):
    t = ad.trades(ad.bbo(ad.events(spark, sf_dir)))
    return kernels.block_bootstrap(t.select((F.col("symbol") % 10).alias("run"), F.col("seq").alias("step"), (F.col("dir") * F.col("shares")).cast("double").alias("x")), 500, 1)


@R.add()
def b1_matching(spark, sf_dir):
    q = ad.bbo(ad.events(spark, sf_dir))
    o = q.select((F.col("symbol") % 10).alias("symbol"), "seq", F.col("seq").alias("ref"), (F.col("symbol") % 7).alias("owner"), F.when(F.col("seq") % 2 == 0, "B").otherwise("S").alias("side"), (1 + F.col("v") % 900).alias("shares"), (100_000 + 100 * (F.col("v") % 21 - 10)).alias("price"), (F.col("event_type") == "error").alias("ioc"), (F.col("event_type") == "signup").alias("post_only"))
    return sim.match_orders(o, "cancel_old")


@R.add()
def b8_sweep(spark, sf_dir):
    runs = [("naive", {"max_position": m}) for m in (100, 300)] + [("imbalance", {"edge": 0.2}), ("microprice", {}), ("avellaneda_stoikov", {}), ("zero", {})]
    return sim.sweep(_messages(spark, sf_dir), runs).drop("minutes")


@R.add()
def r13_maker_sessions(spark, sf_dir):
    return pm_exec.replay(ad.pm_quotes(ad.events(spark, sf_dir)), {"repeat": 5, "delay": 7})


@R.add()
def r17_maker_sweep(spark, sf_dir):
    """Quoters and settings over every group's quotes, with fees and failing settlements."""
    runs = pm_exec.variants(["logit", "skew"], gamma=[0.1, 0.5], fee_ppm=[0, 20_000])
    return pm_exec.replay(ad.pm_quotes(ad.events(spark, sf_dir)), {"repeat": 5, "fail": 11}, runs)


@R.add()
def s25_random_flow(spark, sf_dir):
    return kernels.sweep(flows.generate(spark, "random", 7, 4, 2000)).groupBy("symbol").agg(F.count(F.lit(1)).alias("msgs"), F.count(F.when(~F.col("ok"), 1)).alias("refused"))


@R.add(ad.sql("select msg_type, count(*) as n, cast(sum(coalesce(shares, 0)) as bigint) as shares, cast(sum(coalesce(price, 0)) as bigint) as price from messages group by msg_type", "messages"))
def s2_round_trip(spark, sf_dir):
    """Messages written as frames, decoded again, and summed.

    A feed has 65,536 locate codes, so symbols are dealt to feeds. Price fields are unsigned: a price
    below zero is written as two's complement, and one of over 31 bits is an error.
    """
    m = _messages(spark, sf_dir).withColumn("ts_ns", F.col("ts_us") % 86_400_000_000 * 1000).withColumn("stock", F.col("symbol").cast("string"))
    m = m.withColumn("feed", F.floor(F.col("symbol") / 65_536)).withColumn("locate", F.pmod("symbol", F.lit(65_536)).cast("int"))
    fits = F.col("price").isNull() | F.col("price").between(-(2**31), 2**31 - 1)
    m = m.withColumn("price", F.when(fits, F.pmod("price", F.lit(2**32))).otherwise(F.raise_error("a price has over 31 bits")))
    framed = itch.as_frames(m.select("feed", "seq", "ts_ns", "locate", "msg_type", "ref", "new_ref", "side", "shares", "price", "stock"))
    at = lambda o, n: F.conv(F.hex(F.substring("frame", o, n)), 16, 10).cast("long")  # noqa: E731  big-endian unsigned
    kind = F.substring("frame", 3, 1).cast("string")
    shares = F.when(kind == "A", at(23, 4)).when(kind.isin("E", "X"), at(22, 4)).when(kind == "U", at(30, 4)).otherwise(0)
    price = F.when(kind == "A", at(35, 4)).when(kind == "U", at(34, 4)).otherwise(0)
    price = F.when(price < 2**31, price).otherwise(price - 2**32)
    return framed.select(kind.alias("msg_type"), shares.alias("shares"), price.alias("price")).groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.sum("price").alias("price"))


@R.add(ad.sql("with h as (select *, bid_px - lag(ask_px, 3) over (partition by symbol order by seq) as x from bbo), c as (select *, coalesce(x > 0, false) as crossed from h), s as (select *, sum(case when crossed then 0 else 1 end) over (partition by symbol order by seq rows unbounded preceding) as island from c) select symbol, max(n) as longest_us from (select symbol, island, max(ts_us) - min(ts_us) as n from s where crossed group by all) group by symbol", "bbo"))
def w19_longest_cross(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("seq")
    q = ad.bbo(ad.events(spark, sf_dir)).withColumn("crossed", F.coalesce(F.col("bid_px") > F.lag("ask_px", 3).over(w), F.lit(False)))
    s = q.withColumn("island", F.sum(F.when(F.col("crossed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("crossed")
    return s.groupBy("symbol", "island").agg((F.max("ts_us") - F.min("ts_us")).alias("n")).groupBy("symbol").agg(F.max("n").alias("longest_us"))
