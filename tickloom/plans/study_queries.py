"""Queries of the studies module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import book, micro, studies
from tickloom.plans import adapters as ad
from tickloom.plans.micro_queries import DAY_US, INTERVALS, quotes
from tickloom.plans.registry import Registry

R = Registry()


@R.add(ad.sql("with lv as (select symbol, seq, side, price, sum(dqty) over (partition by symbol, side, price order by seq rows unbounded preceding) - dqty as ahead from (select symbol, seq, side, price, sum(dqty) as dqty from deltas group by all)), ff as (select symbol, ref, min(seq) as fill_seq, arg_min(ts_us, seq) as fill_ts from messages where msg_type = 'E' group by all), j as (select o.*, ahead, fill_seq, fill_ts from orders_t o join lv on o.symbol = lv.symbol and o.add_seq = lv.seq and o.side = lv.side and o.price = lv.price left join ff on o.symbol = ff.symbol and o.ref = ff.ref) select cast(case when ahead <= 0 then 0 when ahead <= 100 then 1 when ahead <= 300 then 2 when ahead <= 1000 then 3 when ahead <= 3000 then 4 else 5 end as bigint) as bucket, count(*) as orders, count(fill_seq) as traded, round(avg((fill_ts - add_ts) / 1e6), 3) as mean_wait_s from j group by 1", "deltas"))
def a9_queue_positions(spark, sf_dir):
    m = ad.messages(quotes(spark, sf_dir))
    lives = book.order_lives(m)
    return studies.queue_positions(lives, book.running_levels(book.level_deltas(m, lives)), studies.first_fills(m))


@R.add(ad.sql("select symbol, ref, min(seq) as fill_seq, arg_min(ts_us, seq) as fill_ts from messages where msg_type = 'E' group by all", "messages"))
def w21_first_fills(spark, sf_dir):
    return studies.first_fills(ad.messages(quotes(spark, sf_dir)))


@R.add(ad.sql(f"with {INTERVALS}, p as (select *, 0.01 * ofi as p from iv) select symbol, count(*) as n, round(case when count(*) >= 3 and var_pop(dmid2) > 0 then 1 - sum((dmid2 - p) ** 2) / (var_pop(dmid2) * count(*)) end, 6) as r2 from p group by symbol", "bbo"))
def a14_out_of_sample_r2(spark, sf_dir):
    iv = micro.ofi_intervals(quotes(spark, sf_dir), DAY_US).withColumn("p", F.col("ofi") * 0.01)
    return studies.out_of_sample_r2(iv, "dmid2", "p", ["symbol"])


@R.add()
def a15_prediction_errors(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return studies.prediction_errors(q, micro.micro_price(micro.transitions(q, ad.TICK)), ad.TICK)


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of three pools that all symbols are dealt to."""
    iv = micro.ofi_intervals(quotes(spark, sf_dir), DAY_US)
    return iv.groupBy((F.col("symbol") % 3 + 1).alias("symbol"), "k").agg(F.sum("ofi").alias("ofi"), F.sum("dmid2").alias("dmid2"))


@R.add(ad.sql(f"with {INTERVALS}, pv as (select symbol % 3 + 1 as symbol, k, cast(sum(ofi) as bigint) as ofi, cast(sum(dmid2) as bigint) as dmid2 from iv group by 1, 2), w as (select k, coalesce(max(case when symbol = 1 then ofi end), 0) as x1, coalesce(max(case when symbol = 2 then ofi end), 0) as x2, coalesce(max(case when symbol = 3 then ofi end), 0) as x3 from pv group by k), t as (select symbol, k, lead(dmid2) over (partition by symbol order by k) as next from pv) select t.symbol, t.k, t.next, x1, x2, x3 from t join w on t.k = w.k where t.next is not null", "bbo"))
def j11_cross_impact(spark, sf_dir):
    return studies.cross_impact(_pools(spark, sf_dir), [1, 2, 3])


@R.add()
def e15_cross_impact_fit(spark, sf_dir):
    x = studies.cross_impact(_pools(spark, sf_dir), [1, 2, 3])
    rows = [(s, i, round(b, 9)) for s in (1, 2, 3) for i, b in enumerate(micro.ridge(x.where(F.col("symbol") == s), ["x1", "x2", "x3"], "next"))]
    return spark.createDataFrame(rows, "symbol long, term long, coefficient double")


@R.add()
def a19_hash_sample(spark, sf_dir):
    return studies.hash_sample(quotes(spark, sf_dir).select("symbol", "seq", "v"), "seq", 200)


@R.add(ad.sql("with s as (select v, greatest(floor(log2(greatest(v, 1))) - 4, 0)::int as s from tape) select (v >> s) << s as low, count(*) as n from s group by 1", "tape"))
def a20_latency_histogram(spark, sf_dir):
    return studies.latency_histogram(ad.tape(ad.events(spark, sf_dir)), "v")


@R.add()
def e20_fill_intensity(spark, sf_dir):
    m = ad.messages(quotes(spark, sf_dir))
    lives = book.order_lives(m)
    orders = lives.select((F.col("shares") % 32).cast("double").alias("distance"), ((F.coalesce("end_ts", "add_ts") - F.col("add_ts")) / 3.6e9).alias("exposed"), (F.col("executed") > 0).alias("filled"))
    bins = studies.intensity_bins(orders).collect()  # at most 32 rows
    a, k = studies.fit_intensity({b["bin"]: b["exposure"] for b in bins}, {b["bin"]: b["fills"] for b in bins})
    return spark.createDataFrame([(round(a, 6), round(k, 6))], "a double, k double")


@R.add(ad.sql("with r as (select symbol, seq % 4 as param, sum(-dir * shares * price) as total, count(*) as fills from trades group by all) select param, count(*) as runs, cast(sum(total) as bigint) as total, cast(sum(fills) as bigint) as fills from r group by param", "trades"))
def a24_sweep_totals(spark, sf_dir):
    """Trades as the fills of four parameter sets over every symbol, best first."""
    t = ad.trades(ad.bbo(ad.events(spark, sf_dir)))
    runs = t.groupBy("symbol", (F.col("seq") % 4).alias("param")).agg(F.sum(-F.col("dir") * F.col("shares") * F.col("price")).alias("total"), F.count(F.lit(1)).alias("fills"))
    return studies.sweep_totals(runs, ["param"])
