"""Microstructure queries over the quotes and trades that the events table gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import micro
from tickloom.plans import adapters as ad
from tickloom.plans.registry import Registry

R = Registry()
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
SPLIT_US = 1_705_320_000_000_000


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.bbo(ad.events(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = quotes(spark, sf_dir)
    return ad.trades(q), q


@R.add(ad.sql(f"select symbol, seq, bid_px, ask_px from bbo where ts_us % {DAY_US} >= {10 * HOUR_US} and ts_us % {DAY_US} < {15 * HOUR_US + HOUR_US // 2}", "bbo"))
def p1_session_window(spark, sf_dir):
    return micro.session(quotes(spark, sf_dir), 10 * HOUR_US, 15 * HOUR_US + HOUR_US // 2).select("symbol", "seq", "bid_px", "ask_px")


@R.add(ad.sql("select symbol, seq, coalesce(last_value(case event_type when 'error' then 'H' when 'signup' then 'T' end ignore nulls) over (partition by symbol order by seq rows unbounded preceding), 'T') as state from bbo", "bbo"))
def p2_trading_state(spark, sf_dir):
    told = F.when(F.col("event_type") == "error", "H").when(F.col("event_type") == "signup", "T")
    return micro.trading_state(quotes(spark, sf_dir), told).select("symbol", "seq", "state")


@R.add(ad.sql("select symbol, seq from (select *, lag(seq) over w as p, lag(bid_px) over w as b, lag(ask_px) over w as a, lag(bid_qty) over w as bq, lag(ask_qty) over w as aq from bbo window w as (partition by symbol order by seq)) where p is null or b <> bid_px or a <> ask_px or bq <> bid_qty or aq <> ask_qty", "bbo"))
def p7_changed_quotes(spark, sf_dir):
    return micro.changed_quotes(quotes(spark, sf_dir)).select("symbol", "seq")


OFI = "select *, bid_px + ask_px as mid2, bid_qty + ask_qty as depth2, case when b0 is not null then case when bid_px >= b0 then bid_qty else 0 end - case when bid_px <= b0 then bq0 else 0 end - case when ask_px <= a0 then ask_qty else 0 end + case when ask_px >= a0 then aq0 else 0 end end as ofi from (select *, lag(bid_px) over w as b0, lag(ask_px) over w as a0, lag(bid_qty) over w as bq0, lag(ask_qty) over w as aq0 from bbo window w as (partition by symbol order by seq))"


@R.add(ad.sql(f"select symbol, seq, ts_us, mid2, depth2, ofi from ({OFI})", "bbo"))
def f7_ofi_events(spark, sf_dir):
    return micro.ofi_events(quotes(spark, sf_dir))


INTERVALS = f"e as ({OFI}), part as (select symbol, ts_us // {DAY_US} as k, cast(sum(coalesce(ofi, 0)) as bigint) as ofi, max_by(mid2, seq) as last2, sum(depth2) as ds, count(*) as n from e group by 1, 2), ends as (select symbol, min(k) as a, max(k) as b from part group by symbol), every as (select symbol, unnest(range(a, b + 1)) as k from ends), filled as (select f.symbol, f.k, coalesce(p.ofi, 0) as ofi, last_value(last2 ignore nulls) over w as mid2, last_value(ds / (2.0 * n) ignore nulls) over w as depth from every f left join part p on f.symbol = p.symbol and f.k = p.k window w as (partition by f.symbol order by f.k rows unbounded preceding)), iv as (select symbol, k, ofi, mid2 - coalesce(lag(mid2) over (partition by symbol order by k), mid2) as dmid2, round(depth, 6) as depth from filled)"


@R.add(ad.sql(f"with {INTERVALS} select symbol, k, ofi, dmid2, depth from iv", "bbo"))
def a5_ofi_intervals(spark, sf_dir):
    return micro.ofi_intervals(quotes(spark, sf_dir), DAY_US)


@R.add(ad.sql(f"with {INTERVALS} select symbol, count(*) as n, round(coalesce(regr_slope(dmid2, ofi), 0), 6) as slope, round(coalesce(regr_intercept(dmid2, ofi), 0), 6) as intercept, round(coalesce(regr_r2(dmid2, ofi), 0), 6) as r2 from iv group by symbol having count(*) >= 3 and var_pop(ofi) > 0 union all select symbol, count(*), 0, 0, 0 from iv group by symbol having not (count(*) >= 3 and var_pop(ofi) > 0)", "bbo"))
def e1_ofi_regression(spark, sf_dir):
    return micro.regression(micro.ofi_intervals(quotes(spark, sf_dir), DAY_US), "dmid2", "ofi", ["symbol"])


GRID = f"ends as (select symbol, (min(ts_us) // {DAY_US} + 1) * {DAY_US} as a, max(ts_us) // {DAY_US} * {DAY_US} as b from bbo group by symbol), times as (select symbol, unnest(range(a, b + 1, {DAY_US})) as g from ends), gridded as (select t.symbol, t.g, q.bid_px + q.ask_px as mid2 from times t asof left join bbo q on t.symbol = q.symbol and t.g >= q.ts_us)"


@R.add(ad.sql(f"with {GRID} select symbol, g, mid2 from gridded", "bbo"))
def w10_grid_mids(spark, sf_dir):
    return micro.second_grid(quotes(spark, sf_dir), DAY_US)


@R.add(ad.sql(f"with {GRID} select symbol, cast(k as bigint) as lag, round(sum(r * r) / k * 1e6, 6) as rv from (" + " union all ".join(f"select symbol, {k} as k, ln(mid2 / lag(mid2, {k}) over (partition by symbol order by g)) as r from gridded" for k in (1, 2, 5)) + ") group by symbol, k", "bbo"))
def e8_volatility_signature(spark, sf_dir):
    return micro.volatility_signature(micro.second_grid(quotes(spark, sf_dir), DAY_US), (1, 2, 5))


STATES = "st as (select symbol, seq, least((bid_qty * 10) // (bid_qty + ask_qty), 9) + 10 * ((ask_px - bid_px) // 100 - 1) as s, bid_px + ask_px as mid2 from bbo where ask_px - bid_px in (100, 200)), mv as (select * from (select lag(s) over w as f, s as t, mid2 - lag(mid2) over w as d2 from st window w as (partition by symbol order by seq)) where f is not null and (f <> t or d2 <> 0))"


@R.add(ad.sql(f'with {STATES} select f as "from", t as "to", d2, count(*) as n from (select f, t, d2 from mv union all select 9 - f % 10 + 10 * (f // 10), 9 - t % 10 + 10 * (t // 10), -d2 from mv) group by all', "bbo"))
def a6_transitions(spark, sf_dir):
    return micro.transitions(quotes(spark, sf_dir), ad.TICK)


@R.add()
def e2_micro_price(spark, sf_dir):
    g = micro.micro_price(micro.transitions(quotes(spark, sf_dir), ad.TICK))
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(g)], "state long, g double")


@R.add(ad.sql(f"select w, round(median(spread), 6) as median_spread, count(*) as n from (select symbol, ts_us // {DAY_US} as day, (ts_us % {DAY_US}) // {4 * HOUR_US} as w, avg(ask_px - bid_px) as spread from bbo group by all) group by w", "bbo"))
def e10_intraday_medians(spark, sf_dir):
    return micro.intraday_medians(quotes(spark, sf_dir), 4 * HOUR_US)


@R.add(ad.sql("with m as (select symbol, seq, sign(d) as s from (select symbol, seq, bid_px + ask_px - lag(bid_px + ask_px) over (partition by symbol order by seq) as d from bbo) where d <> 0), l as (select symbol, s, lag(s) over (partition by symbol order by seq) as p from m), c as (select symbol, count(*) filter (s = p) as same, count(*) filter (s <> p) as turned from l where p is not null group by symbol) select symbol, same, turned, round(case when turned > 0 then same / (2.0 * turned) end, 6) as eta from c", "bbo"))
def e17_eta(spark, sf_dir):
    return micro.eta(quotes(spark, sf_dir))


@R.add(ad.sql("select event_type, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round((avg(v * v * v::double) - 3 * avg(v) * avg(v * v::double) + 2 * avg(v) ** 3) / stddev_pop(v) ** 3, 5) as skew, round(kurtosis_pop(v) + 3, 5) as kurt from bbo group by event_type", "bbo"))
def a16_moments(spark, sf_dir):
    return micro.moments(quotes(spark, sf_dir), "v", ["event_type"])


@R.add(ad.sql("with d as (select event_type, seq, v - avg(v) over (partition by event_type) as d from bbo), l as (select event_type, d, lag(d) over (partition by event_type order by seq) as b from d) select event_type, round(sum(d * b) / sum(d * d), 5) as acf from l group by event_type", "bbo"))
def a17_autocorrelation(spark, sf_dir):
    return micro.autocorrelation(quotes(spark, sf_dir), "v", "event_type", "seq", 1)


@R.add(ad.sql("select symbol, list_sort(list(v))[count(*) // 2 + 1] as upper_median from bbo group by symbol", "bbo"))
def a12_upper_median(spark, sf_dir):
    return micro.upper_median(quotes(spark, sf_dir), "v", ["symbol"])


@R.add(ad.sql("select event_type, round(quantile_cont(v, 0.1), 6) as p10, round(median(v), 6) as p50, round(quantile_cont(v, 0.9), 6) as p90 from bbo group by event_type", "bbo"))
def a18_quantiles(spark, sf_dir):
    p = lambda q, name: F.round(F.percentile("v", F.lit(q)), 6).alias(name)
    return quotes(spark, sf_dir).groupBy("event_type").agg(p(0.1, "p10"), p(0.5, "p50"), p(0.9, "p90"))


MARKOV = f"st as (select symbol, seq, ts_us, (least(greatest(floor((ask_px - bid_px) / 100.0 + 0.5), 1), 3) - 1)::bigint * 5 + least((bid_qty * 5) // (bid_qty + ask_qty), 4) as state, bid_px + ask_px as mid2 from bbo), mv as (select * from (select symbol, seq, ts_us < {SPLIT_US} as fit, state, lag(state) over w as before, sign(mid2 - lag(mid2) over w)::bigint as up, ts_us - lag(ts_us) over w as held from st window w as (partition by symbol order by seq)) where before is not null)"


@R.add(ad.sql(f"with {MARKOV} select before, state, count(*) as n, cast(sum(held) as bigint) as held, count(*) filter (fit and up > 0) as ups, count(*) filter (fit and up < 0) as downs from mv group by before, state", "bbo"))
def e13_markov_table(spark, sf_dir):
    return micro.markov_table(micro.markov_moves(quotes(spark, sf_dir), 5, 3, ad.TICK, SPLIT_US))


@R.add(ad.sql(f"with {MARKOV}, seen as (select before, count(*) filter (up > 0) as ups, count(*) filter (up < 0) as downs from mv where fit and up <> 0 group by before) select count(*) as moves, count(*) filter (sign(coalesce(ups, 0) - coalesce(downs, 0)) = up) as hits, greatest(count(*) filter (up > 0), count(*) filter (up < 0)) as baseline from mv left join seen on mv.before = seen.before where not fit and up <> 0", "bbo"))
def e13_markov_score(spark, sf_dir):
    return micro.markov_score(micro.markov_moves(quotes(spark, sf_dir), 5, 3, ad.TICK, SPLIT_US))


HORIZON = 6 * HOUR_US
MARKED = f"marked as (select t.*, q.bid_px + q.ask_px as later_mid2, t.ts_us + {HORIZON} <= e.data_end as resolved, case when t.shares <= 100 then '1-100' when t.shares <= 500 then '101-500' when t.shares <= 2000 then '501-2000' else 'over 2000' end as size from trades t asof left join bbo q on t.symbol = q.symbol and t.ts_us + {HORIZON} > q.ts_us join (select symbol, max(ts_us) as data_end from bbo group by symbol) e on t.symbol = e.symbol)"


def _marked(spark, sf_dir):
    t, q = trades(spark, sf_dir)
    return micro.marked_trades(t, q, HORIZON)


@R.add(ad.sql(f"with {MARKED} select symbol, seq, later_mid2, resolved from marked", "trades"))
def j4_markouts(spark, sf_dir):
    return _marked(spark, sf_dir).select("symbol", "seq", "later_mid2", "resolved")


@R.add(ad.sql(f"with {MARKED} select ts_us // {DAY_US} as day, size, count(*) as n, cast(sum(shares) as bigint) as shares, round(sum(shares * dir * (2 * price - bid_px - ask_px) / (bid_px + ask_px) * 1e4) / sum(shares), 4) as effective, round(sum(shares * dir * (2 * price - later_mid2) / (bid_px + ask_px) * 1e4) / sum(shares), 4) as realized, round(sum(shares * dir * (later_mid2 - bid_px - ask_px) / (bid_px + ask_px) * 1e4) / sum(shares), 4) as impact from marked where resolved and not hidden group by 1, 2", "trades"))
def e5_trade_costs(spark, sf_dir):
    return micro.trade_costs(_marked(spark, sf_dir))


IMPROVED = "case sign(2 * price - bid_px - ask_px) when 1 then 2 * (ask_px - price) when -1 then 2 * (price - bid_px) else ask_px - bid_px end"
EXECS = f"cast(sum(case when not hidden then 1 else 0 end) as bigint) as execs, cast(sum(case when not hidden then shares else 0 end) as bigint) as shares, cast(sum(case when not hidden then shares * dir * (2 * price - bid_px - ask_px) else 0 end) as bigint) as effective, cast(sum(case when resolved and not hidden then shares * dir * (2 * price - later_mid2) else 0 end) as bigint) as realized, cast(sum(case when resolved and not hidden then shares * dir * (later_mid2 - bid_px - ask_px) else 0 end) as bigint) as impact, cast(sum(case when hidden and price > bid_px and price < ask_px then shares else 0 end) as bigint) as hidden_shares, cast(sum(case when hidden and price > bid_px and price < ask_px then shares * ({IMPROVED}) else 0 end) as bigint) as improved"


@R.add(ad.sql(f"with {MARKED} select coalesce(m.symbol::varchar, 'all') as symbol, coalesce(m.size, 'all') as size, {EXECS} from marked m group by rollup(m.symbol, m.size)", "trades"))
def e6_best_execution(spark, sf_dir):
    return micro.best_execution(_marked(spark, sf_dir))


@R.add(ad.sql("select symbol, seq, sign(2 * price - bid_px - ask_px)::bigint as sign from trades", "trades"))
def f9_trade_sign(spark, sf_dir):
    from tickloom.functions.market import trade_sign

    return trades(spark, sf_dir)[0].select("symbol", "seq", trade_sign().alias("sign"))


VOLUME = 20_000
BUCKETS = f"cum as (select *, sum(shares) over (partition by symbol order by seq rows unbounded preceding)::bigint as hi from trades), parts as (select *, hi - shares as lo, unnest(range((hi - shares) // {VOLUME}, (hi - 1) // {VOLUME} + 1)) as b from cum), vb as (select symbol, b as bucket, abs(sum((least(hi, (b + 1) * {VOLUME}) - greatest(lo, b * {VOLUME})) * dir))::bigint as abs_net, max_by(bid_px + ask_px, seq) as mid2 from parts group by symbol, b having sum(least(hi, (b + 1) * {VOLUME}) - greatest(lo, b * {VOLUME})) = {VOLUME})"


@R.add(ad.sql(f"with {BUCKETS} select symbol, bucket, abs_net, mid2 from vb", "trades"))
def w20_volume_buckets(spark, sf_dir):
    return micro.volume_buckets(trades(spark, sf_dir)[0], VOLUME)


@R.add(ad.sql(f"with {BUCKETS} select symbol, bucket, round(s / (5.0 * {VOLUME}), 6) as vpin from (select symbol, bucket, sum(abs_net) over (partition by symbol order by bucket rows 4 preceding) as s, row_number() over (partition by symbol order by bucket) - 1 as i from vb) where i >= 5", "trades"))
def e7_vpin(spark, sf_dir):
    return micro.vpin(micro.volume_buckets(trades(spark, sf_dir)[0], VOLUME), VOLUME, 5)


MOVES = "moves as (select symbol, seq, ts_us, sign(d)::bigint as up from (select symbol, seq, ts_us, bid_px + ask_px - lag(bid_px + ask_px) over (partition by symbol order by seq) as d from bbo) where d <> 0)"


def _lead_sql(shift: int) -> str:
    return ad.sql(f"with {MOVES}, near as (select p.leader, p.follower, a.up, a.ts_us + {shift} as t0, b.ts_us as t, b.up as answer from (select distinct symbol as leader, symbol + 1 as follower from bbo) p join moves a on a.symbol = p.leader asof join moves b on b.symbol = p.follower and a.ts_us + {shift} < b.ts_us) select leader::bigint as leader, follower::bigint as follower, count(*) as leads, count(*) filter (t - t0 <= {12 * HOUR_US}) as answered, count(*) filter (t - t0 <= {12 * HOUR_US} and answer = up) as same from near group by 1, 2", "bbo")


def _lead(spark, sf_dir, shift):
    """Each symbol as the leader of the next one."""
    q = quotes(spark, sf_dir)
    pairs = q.select(F.col("symbol").alias("leader"), (F.col("symbol") + 1).alias("follower")).distinct()
    return micro.lead_lag(micro.mid_moves(q), pairs, 12 * HOUR_US, shift)


@R.add(_lead_sql(0))
def e12_lead_lag(spark, sf_dir):
    return _lead(spark, sf_dir, 0)


@R.add(_lead_sql(2 * HOUR_US))
def e12_lead_lag_placebo(spark, sf_dir):
    return _lead(spark, sf_dir, 2 * HOUR_US)


def levels(q: DataFrame, n: int = 5) -> DataFrame:
    """Five levels a side by rule: 100 apart, sizes from the best's."""
    side = lambda px, qty, sign: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda l: F.struct((px + sign * 100 * l).alias("px"), (1 + qty * (l + 1) % 900).alias("qty")))
    return micro.depth_levels(q, side(F.col("bid_px"), F.col("bid_qty"), -1), side(F.col("ask_px"), F.col("ask_qty"), 1))


LEVELS = "lv as (select symbol, seq, ts_us, l as level, bid_px - 100 * l as bid_px, ask_px + 100 * l as ask_px, 1 + bid_qty * (l + 1) % 900 as bid_qty, 1 + ask_qty * (l + 1) % 900 as ask_qty from bbo, (select unnest(range(5)) as l)), ev as (select symbol, ts_us, level, case when bid_px >= b0 then bid_qty else 0 end - case when bid_px <= b0 then bq0 else 0 end - case when ask_px <= a0 then ask_qty else 0 end + case when ask_px >= a0 then aq0 else 0 end as e from (select *, lag(bid_px) over w as b0, lag(ask_px) over w as a0, lag(bid_qty) over w as bq0, lag(ask_qty) over w as aq0 from lv window w as (partition by symbol, level order by seq)) where b0 is not null), ml as (select symbol, ts_us // 86400000000 as k, level, cast(sum(e) as bigint) as ofi from ev group by all)"


@R.add(ad.sql(f"with {LEVELS}, all_k as (select distinct symbol, ts_us // {DAY_US} as k, level from lv) select a.symbol, a.k, a.level, coalesce(m.ofi, 0) as ofi from all_k a left join ml m on a.symbol = m.symbol and a.k = m.k and a.level = m.level", "bbo"))
def e14_multi_level_ofi(spark, sf_dir):
    return micro.mlofi(levels(quotes(spark, sf_dir)), DAY_US)


def _wide(spark, sf_dir):
    return micro.mlofi(levels(quotes(spark, sf_dir)), DAY_US).groupBy("symbol", "k").pivot("level", list(range(5))).agg(F.first("ofi")).select("symbol", "k", *[F.col(str(i)).alias(f"l{i}") for i in range(5)])


@R.add()
def e14_first_component(spark, sf_dir):
    w, share = micro.first_component(_wide(spark, sf_dir), [f"l{i}" for i in range(5)])
    return spark.createDataFrame([(i, round(x, 6), round(share, 6)) for i, x in enumerate(w)], "level long, weight double, share double")


@R.add()
def e15_ridge_forecast(spark, sf_dir):
    b = micro.ridge(_wide(spark, sf_dir), [f"l{i}" for i in range(1, 5)], "l0")
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(b)], "term long, coefficient double")


@R.add(ad.sql("with a as (select v as x from bbo where symbol % 2 = 0), b as (select v as x from bbo where symbol % 2 = 1), e as (select list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as edges from (select x from a union all select x from b)), n as (select s, len(list_filter(edges, lambda q: q <= x)) as bin from (select 0 as s, x from a union all select 1, x from b), e), p as (select bin, count(*) filter (s = 0) as a, count(*) filter (s = 1) as b from n group by bin) select round(sum(abs(a / (select sum(a) from p) - b / (select sum(b) from p))) / 2, 6) as tv from p", "bbo"))
def e16_total_variation(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return micro.total_variation(q.where("symbol % 2 = 0"), q.where("symbol % 2 = 1"), "v", 10)


QS = ", ".join(str((k + 0.5) / 100) for k in range(100))


@R.add(ad.sql(f"with a as (select unnest(quantile_cont(v, [{QS}])) as x, unnest(range(100)) as k from bbo where symbol % 2 = 0), b as (select unnest(quantile_cont(v, [{QS}])) as x, unnest(range(100)) as k from bbo where symbol % 2 = 1) select round(avg(abs(a.x - b.x)) / (select stddev_samp(v) from bbo where symbol % 2 = 0), 6) as w1 from a join b on a.k = b.k", "bbo"))
def e16_wasserstein(spark, sf_dir):
    q = quotes(spark, sf_dir)
    return micro.wasserstein(q.where("symbol % 2 = 0"), q.where("symbol % 2 = 1"), "v", 100)
