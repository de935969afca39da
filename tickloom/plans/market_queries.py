"""Surveillance, prediction-market and evaluation queries over the tables that events and order lines give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import market as fm
from tickloom.functions import models
from tickloom.operators import book, micro, pm, stats, surveil
from tickloom.plans import adapters as ad
from tickloom.plans.registry import Registry

R = Registry()
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _log(spark, sf_dir):
    q = ad.bbo(ad.events(spark, sf_dir))
    m = ad.messages(q)
    return m, book.order_lives(m), q


STUFF = f"b as (select symbol, ts_us // {DAY_US} as bucket, count(*) as msgs, count(*) filter (msg_type = 'E') as execs, count(*) filter (msg_type in ('X', 'D', 'U')) as cancels from messages group by all), md as (select symbol, greatest(list_sort(list(msgs))[count(*) // 2 + 1], 1) as median from b group by symbol), hot as (select b.*, median from b join md on b.symbol = md.symbol where msgs >= 3 and msgs >= 1.5 * median and execs <= 0.4 * msgs and cancels >= 0.4 * msgs), isl as (select *, bucket - row_number() over (partition by symbol order by bucket) as island from hot)"


@R.add(ad.sql(f"with {STUFF} select symbol, min(bucket) * {DAY_US} as start_us, (max(bucket) + 1) * {DAY_US} as end_us, cast(sum(msgs) as bigint) as msgs, cast(sum(cancels) as bigint) as cancels, cast(sum(execs) as bigint) as execs, round(max(msgs / median), 6) as rate_multiple from isl group by symbol, island", "messages"))
def e23_stuffing(spark, sf_dir):
    return surveil.stuffing(_log(spark, sf_dir)[0], DAY_US, 3, 1.5, 0.4, 0.4)


@R.add(ad.sql(f"select symbol, ts_us // {DAY_US} as bucket, count(*) as msgs, count(*) filter (msg_type = 'E') as execs, count(*) filter (msg_type in ('X', 'D', 'U')) as cancels from messages group by all", "messages"))
def a3_message_buckets(spark, sf_dir):
    return surveil.message_buckets(_log(spark, sf_dir)[0], DAY_US)


SPOOFS = f"q as (select symbol, seq, bid_px, ask_px from bbo), c as (select o.*, q.bid_px, q.ask_px from orders_t o asof left join q on o.symbol = q.symbol and o.add_seq > q.seq where o.end_kind in ('D', 'U')), x as (select m.symbol, m.seq, sum(case when o.side = 'B' then m.shares else 0 end) over w as cb, sum(case when o.side = 'S' then m.shares else 0 end) over w as cs from messages m join orders_t o on m.symbol = o.symbol and m.ref = o.ref where m.msg_type = 'E' window w as (partition by m.symbol order by m.seq rows unbounded preceding)), p as (select *, case when side = 'B' then price >= ask_px else price <= bid_px end as crosses, case when side = 'B' then price >= bid_px else price <= ask_px end as joins from c where executed = 0 and end_ts - add_ts <= {4 * DAY_US} and shares >= 200), t as (select * from p where not coalesce(crosses, false) and coalesce(joins, true)), a as (select t.*, coalesce(x.cb, 0) as ab, coalesce(x.cs, 0) as as_ from t asof left join x on t.symbol = x.symbol and t.add_seq > x.seq), e as (select a.*, coalesce(x.cb, 0) as eb, coalesce(x.cs, 0) as es from a asof left join x on a.symbol = x.symbol and a.end_seq > x.seq)"


@R.add(ad.sql(f"with {SPOOFS} select symbol, ref, side, price, shares, add_ts, end_ts, cast(case when side = 'B' then es - as_ else eb - ab end as bigint) as opposite from e where case when side = 'B' then es - as_ else eb - ab end >= 0", "orders_t"))
def e21_spoofs(spark, sf_dir):
    m, lives, q = _log(spark, sf_dir)
    return surveil.spoofs(m, lives, q, 4 * DAY_US, 200, 10, 0)


@R.add(ad.sql(f"with {SPOOFS} select count(*) as candidates, count(distinct symbol) as symbols from e where case when side = 'B' then es - as_ else eb - ab end >= 0", "orders_t"))
def a25_spoof_summary(spark, sf_dir):
    m, lives, q = _log(spark, sf_dir)
    return surveil.summary(surveil.spoofs(m, lives, q, 4 * DAY_US, 200, 10, 0))


@R.add(ad.sql(f"with {SPOOFS} select symbol, ref, shares, cast(case when side = 'B' then es - as_ else eb - ab end as bigint) as opposite from e where case when side = 'B' then es - as_ else eb - ab end >= 0 order by opposite desc, shares desc, symbol, ref limit 20", "orders_t"))
def t2_ranked_spoofs(spark, sf_dir):
    m, lives, q = _log(spark, sf_dir)
    found = surveil.spoofs(m, lives, q, 4 * DAY_US, 200, 10, 0)
    return surveil.ranked(found, [F.desc("opposite"), F.desc("shares"), F.col("symbol"), F.col("ref")], 20).select("symbol", "ref", "shares", "opposite")


@R.add(ad.sql(f"with {SPOOFS} select symbol, count(*) as candidates from e where case when side = 'B' then es - as_ else eb - ab end >= 0 group by symbol order by candidates desc, symbol limit 10", "orders_t"))
def a25_most_flagged(spark, sf_dir):
    m, lives, q = _log(spark, sf_dir)
    return surveil.most_flagged(surveil.spoofs(m, lives, q, 4 * DAY_US, 200, 10, 0))


@R.add(ad.sql("with q as (select symbol, seq, bid_px, ask_px from bbo) select o.symbol, o.ref, coalesce(case when side = 'B' then price >= ask_px else price <= bid_px end, false) as crosses, not coalesce(case when side = 'B' then price >= ask_px else price <= bid_px end, false) and coalesce(case when side = 'B' then price >= bid_px else price <= ask_px end, true) as touch from orders_t o asof left join q on o.symbol = q.symbol and o.add_seq > q.seq", "orders_t"))
def p8_touch_classes(spark, sf_dir):
    _, lives, q = _log(spark, sf_dir)
    return surveil.touches(lives, q).select("symbol", "ref", "crosses", "touch")


@R.add()
def e22_layers(spark, sf_dir):
    _, lives, _ = _log(spark, sf_dir)
    named = lives.withColumn("mpid", F.concat(F.lit("M"), (F.col("symbol") % 5).cast("string")))
    return surveil.layers(named, 3 * DAY_US, 4 * DAY_US, 2, 2, 100)


# --- prediction markets


def _changes(spark, sf_dir):
    return ad.pm_changes(ad.events(spark, sf_dir))


PM_BOOK = "c as (select p.*, r.since from pm p asof join (select token, seq as since from pm where seq % 50 = 0) r on p.token = r.token and p.seq >= r.since), latest as (select token, buy, px, arg_max(size, seq) as size, arg_max(since, seq) as since from c where px < 10000 group by all), book as (select l.token, buy, px, size from latest l join (select token, max(since) as now from c group by token) n on l.token = n.token and l.since = n.now where size > 0)"


def _book(spark, sf_dir):
    c = _changes(spark, sf_dir)
    return pm.book(pm.seeded(c, c.where("seq % 50 = 0")))


@R.add(ad.sql(f"with {PM_BOOK} select token, buy, px, size from book", "pm"))
def r1_token_books(spark, sf_dir):
    return _book(spark, sf_dir)


@R.add(ad.sql(f"with {PM_BOOK} select token, max(case when buy then px end) as bid, min(case when not buy then px end) as ask from book group by token", "pm"))
def r1_token_best(spark, sf_dir):
    return pm.best(_book(spark, sf_dir))


@R.add(ad.sql("with told as (select token, seq // 10 as msg, seq as part, bid, ask from pmq), want as (select token, seq // 10 as msg, arg_max(bid, seq) + any_value(case when token % 3 = 0 then 1 else 0 end) as want_bid, arg_max(ask, seq) as want_ask from pmq group by all), l as (select token, msg, arg_max(bid, part) as bid, arg_max(ask, part) as ask from told group by all) select l.token, count(*) as checks, count(*) filter (bid <> want_bid or ask <> want_ask) as wrong from l join want w on l.token = w.token and l.msg = w.msg group by l.token", "pmq"))
def r3_best_mismatches(spark, sf_dir):
    q = ad.pm_quotes(ad.events(spark, sf_dir)).withColumn("msg", F.expr("seq div 10"))
    want = q.groupBy("token", "msg").agg((F.max_by("bid", "seq") + F.when(F.col("token") % 3 == 0, 1).otherwise(0)).alias("bid"), F.max_by("ask", "seq").alias("ask"))
    return pm.mismatches(q.select("token", "msg", F.col("seq").alias("part"), "bid", "ask"), want)


@R.add(ad.sql("select token, count(*) filter (not is_trade) as deltas, count(*) filter (is_trade) as trades, cast(sum(case when is_trade then size else 0 end) as bigint) as shares, cast(sum(case when is_trade then size * px else 0 end) as bigint) as notional, max(ts_us) - min(ts_us) as span_us from pm group by token", "pm"))
def a22_token_totals(spark, sf_dir):
    return pm.token_totals(_changes(spark, sf_dir))


@R.add(ad.sql("select token, cast(sum(case when is_trade then size * px else 0 end) as bigint) as notional, cast(sum(case when is_trade then size else 0 end) as bigint) as shares from pm group by token order by notional desc, token limit 10", "pm"))
def t4_tokens_by_notional(spark, sf_dir):
    return pm.by_notional(pm.token_totals(_changes(spark, sf_dir)), 10).select("token", "notional", "shares")


@R.add(ad.sql("with q as (select *, lead(ts_us) over (partition by token order by seq) - ts_us as dt from pmq) select token, cast(sum(dt) as bigint) as time_us, round(sum((ask - bid) * dt) / sum(dt), 4) as spread, round(sum((bid_size + ask_size) * dt) / sum(dt), 4) as depth from q where dt is not null and ask > bid group by token", "pmq"))
def a21_time_weighted(spark, sf_dir):
    return pm.time_weighted(ad.pm_quotes(ad.events(spark, sf_dir)))


EDGE = "legs as (select *, last_value(case when token % 2 = 0 then ask end ignore nulls) over w as a0, last_value(case when token % 2 = 1 then ask end ignore nulls) over w as a1, last_value(case when token % 2 = 0 then bid end ignore nulls) over w as b0, last_value(case when token % 2 = 1 then bid end ignore nulls) over w as b1, last_value(case when token % 2 = 0 then ask_size end ignore nulls) over w as as0, last_value(case when token % 2 = 1 then ask_size end ignore nulls) over w as as1, last_value(case when token % 2 = 0 then bid_size end ignore nulls) over w as bs0, last_value(case when token % 2 = 1 then bid_size end ignore nulls) over w as bs1 from pmq window w as (partition by grp order by seq rows unbounded preceding)), edge as (select grp, seq, ts_us, true as buying, coalesce(10000 - a0 - a1, 0) as edge, least(as0, as1) as size from legs union all select grp, seq, ts_us, false, coalesce(b0 + b1 - 10000, 0), least(bs0, bs1) from legs), runs as (select *, sum(case when edge > 0 and not coalesce(prev > 0, false) then 1 else 0 end) over (partition by grp, buying order by seq rows unbounded preceding) as run from (select *, lag(edge) over (partition by grp, buying order by seq) as prev from edge)), spells as (select grp, buying, min(case when edge > 0 then ts_us end) as open_us, arg_min(ts_us, seq) filter (edge <= 0) as close_us, arg_min(edge, seq) as open_edge, max(edge) as max_edge, arg_max(size, edge * 100000000 - seq) filter (edge > 0) as size_at_max from runs where run > 0 group by grp, buying, run having count(*) filter (edge <= 0) > 0)"


def _spells(spark, sf_dir):
    q = ad.pm_quotes(ad.events(spark, sf_dir))
    groups = spark.createDataFrame([(t // 2, t, t % 2) for t in range(20)], "grp long, token long, leg int")
    return pm.windows(pm.edges(q, groups, 2))


@R.add(ad.sql(f"with {EDGE} select grp, buying, open_us, close_us, open_edge, max_edge, size_at_max from spells", "pmq"))
def r6_arbitrage_windows(spark, sf_dir):
    return _spells(spark, sf_dir)


@R.add(ad.sql(f"with {EDGE} select grp, count(*) as windows, count(*) filter (buying) as buying, cast(sum(close_us - open_us) as bigint) as open_us, list_sort(list(close_us - open_us))[count(*) // 2 + 1] as median_us, max(max_edge) as max_edge from spells group by grp", "pmq"))
def a23_arbitrage_totals(spark, sf_dir):
    return pm.window_totals(_spells(spark, sf_dir))


@R.add(ad.sql("select * from (select user_id % 7 as tag, user_id as market, cast(sum(cast(round(value * 100) as bigint)) as bigint) as volume, row_number() over (partition by user_id % 7 order by sum(cast(round(value * 100) as bigint)) desc, user_id) as rank from events group by user_id) where rank <= 3"))
def s21_top_markets(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    return pm.top_markets(t.groupBy((F.col("symbol") % 7).alias("tag"), F.col("symbol").alias("market")).agg(F.sum("v").alias("volume")), 3)


@R.add(ad.sql("select event_id as seq, cast(json_extract(props, '$.k') as bigint) as k from events"))
def s18_json_decode(spark, sf_dir):
    return ad.events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.from_json("props", "k long")["k"].alias("k"))


@R.add(ad.sql("select seq, case when v % 7 = 0 then -1 else v % 10000 end as px from tape", "tape"))
def f3_price_parse(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    text = F.when(F.col("v") % 7 == 0, "x.1").otherwise(F.format_string("0.%04d9", F.col("v") % 10000))
    return t.select("seq", fm.pm_price(text).alias("px"))


@R.add(ad.sql("select seq, cast((2 * (v::hugeint * 1000000 * 20000 * (1 + v % 9999) * (10000 - (1 + v % 9999)) * 100000) + 1000000::hugeint * 1000000 * 100000000) // (2 * 1000000::hugeint * 1000000 * 100000000) as bigint) as fee from tape", "tape"))
def f4_taker_fee(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    return t.select("seq", fm.taker_fee(F.col("v") * 1_000_000, 1 + F.col("v") % 9999, F.lit(20_000), 1).alias("fee"))


@R.add(ad.sql("select seq, printf('%02d:%02d:%02d.%03d', (ts_us % 86400000000) // 3600000000, (ts_us // 60000000) % 60, (ts_us // 1000000) % 60, (ts_us // 1000) % 1000) as clock, (ts_us % 86400000000) // 1000 * 1000000 as ns from tape", "tape"))
def f2_clock(spark, sf_dir):
    c = ad.tape(ad.events(spark, sf_dir)).select("seq", fm.ns_to_clock(F.col("ts_us") % DAY_US * 1000).alias("clock"))
    return c.select("seq", "clock", fm.clock_to_ns(F.col("clock")).alias("ns"))


# --- evaluation


def _fills(spark, sf_dir):
    t = ad.trades(ad.bbo(ad.events(spark, sf_dir)))
    return t.select(F.col("symbol").alias("run"), "seq", (F.col("dir") * F.col("shares")).alias("signed"), "price", (F.col("bid_px") + F.col("ask_px")).alias("mid2"), F.col("hidden").alias("maker"))


FILLS = "fills as (select symbol as run, seq, dir * shares as signed, price, bid_px + ask_px as mid2, hidden as maker from trades), acc as (select run, seq, signed, price, mid2, sum(signed) over w as position, -sum(signed * price) over w as cash from fills window w as (partition by run order by seq rows unbounded preceding))"


@R.add(ad.sql(f"with {FILLS} select run, seq, cast(position as bigint) as position, cast(cash as bigint) as cash, cast(2 * cash + position * mid2 as bigint) as profit2, true as balanced from acc", "trades"))
def b5_accounts(spark, sf_dir):
    return stats.accounts(_fills(spark, sf_dir)).select("run", "seq", "position", "cash", "profit2", (F.col("profit2") == F.col("spread2") + F.col("drift2")).alias("balanced"))


def _curve(spark, sf_dir):
    return stats.accounts(_fills(spark, sf_dir)).select("run", F.col("seq").alias("step"), F.col("profit2").alias("total"))


CURVE = f"{FILLS}, curve as (select run, seq as step, cast(2 * cash + position * mid2 as bigint) as total from acc)"


@R.add(ad.sql(f"with {CURVE}, c as (select *, greatest(0, max(total) over (partition by run order by step rows unbounded preceding)) as peak from curve), s as (select *, sum(case when total < peak then 0 else 1 end) over (partition by run order by step rows unbounded preceding) as spell from c), g as (select run, spell, count(*) filter (total < peak) as n, max(peak - total) as fall from s group by all) select run, cast(max(fall) as bigint) as max_drawdown, max(n) as longest_underwater from g group by run", "trades"))
def w13_drawdowns(spark, sf_dir):
    return stats.drawdowns(_curve(spark, sf_dir))


STEPS = f"{CURVE}, st as (select run, step, cast(total - coalesce(lag(total) over (partition by run order by step), 0) as double) as x from curve)"


@R.add(ad.sql(f"with {STEPS} select run, count(*) as steps, round(case when coalesce(stddev_samp(x), 0) > 0 then avg(x) / stddev_samp(x) else 0 end, 6) as sharpe, round(case when sum(case when x < 0 then -x else 0 end) > 0 then sum(case when x > 0 then x else 0 end) / sum(case when x < 0 then -x else 0 end) end, 5) as profit_factor, round(count(*) filter (x > 0) / nullif(count(*) filter (x <> 0), 0), 6) as hit_rate from st group by run", "trades"))
def e24_risk(spark, sf_dir):
    r = stats.risk(_curve(spark, sf_dir))
    return r.select("run", "steps", F.round("sharpe", 6).alias("sharpe"), F.round("profit_factor", 5).alias("profit_factor"), F.round("hit_rate", 6).alias("hit_rate"))


@R.add()
def e24_deflated(spark, sf_dir):
    return stats.deflated(stats.risk(_curve(spark, sf_dir))).select("run", "trials", F.round("hurdle", 6).alias("hurdle"), F.round("psr", 5).alias("psr"), F.round("dsr", 5).alias("dsr"))


@R.add(ad.sql(f"with {FILLS}, g as (select run, count(*) as fills, sum(case when maker then abs(signed) else 0 end) / sum(abs(signed)) as ms, sum(case when signed > 0 then signed * price end) / sum(case when signed > 0 then signed end) / 1e4 as b, sum(case when signed < 0 then signed * price end) / sum(case when signed < 0 then signed end) / 1e4 as s from fills group by run) select run, fills, round(ms, 6) as maker_share, round(b, 6) as buy_vwap, round(s, 6) as sell_vwap, round(s - b, 6) as captured from g", "trades"))
def a26_fill_metrics(spark, sf_dir):
    return stats.fill_metrics(_fills(spark, sf_dir))


@R.add(ad.sql(f"with {FILLS}, d as (select run, row_number() over (partition by run order by seq) as step, signed as x from (select run % 12 as run, seq, signed from fills)) select a.run, b.run as other, count(*) as n, round(covar_samp(a.x, b.x), 4) as cov from d a join d b on a.step = b.step and a.run <= b.run group by 1, 2", "trades"))
def a27_covariances(spark, sf_dir):
    from pyspark.sql import Window

    f = _fills(spark, sf_dir).withColumn("run", F.col("run") % 12)  # pools of runs
    steps = f.select("run", F.row_number().over(Window.partitionBy("run").orderBy("seq")).alias("step"), F.col("signed").alias("x"))
    return stats.covariances(steps)


@R.add(ad.sql("with r as (select symbol % 10 as symbol, seq % 4 as param, seq % 3 <> 0 as train, v * dir as total from (select symbol, seq, shares as v, dir from trades)), t as (select symbol, param, sum(total) as t from r where train group by all), b as (select symbol, arg_min(param, -t * 100 + param) as param from t group by symbol) select r.symbol, r.param, cast(sum(total) as bigint) as test_total from r join b on r.symbol = b.symbol and r.param = b.param where not train group by all", "trades"))
def e29_walk_forward(spark, sf_dir):
    t = ad.trades(ad.bbo(ad.events(spark, sf_dir)))
    return stats.walk_forward(t.select((F.col("symbol") % 10).alias("symbol"), (F.col("seq") % 4).alias("param"), (F.col("seq") % 3 != 0).alias("train"), (F.col("shares") * F.col("dir")).alias("total")))


@R.add()
def e11_bootstrap_median(spark, sf_dir):
    q = ad.bbo(ad.events(spark, sf_dir)).groupBy("symbol").agg(F.avg(F.col("ask_px") - F.col("bid_px")).alias("spread"))
    return stats.bootstrap_median(q, "spread", 2000, 50, 1949)


@R.add(ad.sql("select symbol, n from (select symbol, count(*) as n from bbo group by symbol) order by n desc, symbol desc limit 20", "bbo"))
def t1_most_active(spark, sf_dir):
    return ad.tape(ad.events(spark, sf_dir)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("symbol")).limit(20)


@R.add(ad.sql("select symbol from tape where ts_us is not null group by symbol having count(distinct ts_us // (7 * 86400000000)) = (select count(distinct ts_us // (7 * 86400000000)) from tape)", "tape"))
def j9_present_every_week(spark, sf_dir):
    week = F.expr("ts_us div (7 * 86400000000)")
    t = ad.tape(ad.events(spark, sf_dir)).select("symbol", week.alias("week")).distinct()
    total = t.select("week").distinct().count()
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == total).select("symbol")


SIZES = "case when shares <= 10 then 'small' when shares <= 30 then 'mid' else 'large' end"


@R.add(ad.sql(f"select coalesce(flag, 'all') as flag, coalesce({SIZES}, 'all') as size, count(*) as n, cast(sum(shares) as bigint) as shares, cast(sum(shares * price) as bigint) as notional from bars group by rollup(flag, {SIZES})", "bars"))
def a4_bars_by_size(spark, sf_dir):
    b = ad.bars(spark, sf_dir).withColumn("size", F.expr(SIZES))
    return b.rollup("flag", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("price")).alias("notional")).withColumn("flag", F.coalesce("flag", F.lit("all"))).withColumn("size", F.coalesce("size", F.lit("all")))


@R.add(ad.sql("select symbol, cast(day as varchar) as day, cast(sum(shares) as bigint) as shares, round(sum(shares * price) / sum(shares), 4) as vwap, min(price) as low, max(price) as high from bars group by symbol, day", "bars"))
def a26_daily_bars(spark, sf_dir):
    return ad.bars(spark, sf_dir).groupBy("symbol", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("shares").alias("shares"), F.round(F.sum(F.col("shares") * F.col("price")) / F.sum("shares"), 4).alias("vwap"), F.min("price").alias("low"), F.max("price").alias("high"))


MODEL = "select seq, 1.0 + v % 100 as sv, 1.0 + seq % 50 as su, 0.05 + (v % 80) / 100.0 as p, 0.1 + (seq % 8) / 10.0 as mu from tape"


@R.add(ad.sql(f"with m as ({MODEL}) select seq, round(su / sv, 6) as beta, round(sv / (2 * su), 6) as impact, round(100 + 10 * (p * (1 + mu) / 2) / (p * (1 + mu) / 2 + (1 - p) * (1 - mu) / 2), 6) as ask, round(100 + 10 * (p * (1 - mu) / 2) / (p * (1 - mu) / 2 + (1 - p) * (1 + mu) / 2), 6) as bid, round(100 - (v % 7 - 3) * 0.1::double * 4 * 0.5, 6) as reservation, round(0.1 * 4 * 0.5 + 2 / 0.1 * ln(1 + 0.1 / 1.5), 6) as spread from m join tape using (seq)", "tape"))
def e28_models(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir)).withColumn("sv", 1.0 + F.col("v") % 100).withColumn("su", 1.0 + F.col("seq") % 50).withColumn("p", 0.05 + (F.col("v") % 80) / 100.0).withColumn("mu", 0.1 + (F.col("seq") % 8) / 10.0)
    k = models.kyle(F.col("sv"), F.col("su"))
    g = models.glosten_milgrom(F.lit(100.0), F.lit(110.0), F.col("p"), F.col("mu"))
    a = models.avellaneda_stoikov(F.lit(100.0), (F.col("v") % 7 - 3).cast("double"), F.lit(0.1), F.lit(2.0), F.lit(1.5), F.lit(0.5))
    r = lambda c, name: F.round(c, 6).alias(name)
    return t.select("seq", r(k["beta"], "beta"), r(k["impact"], "impact"), r(g["ask"], "ask"), r(g["bid"], "bid"), r(a["reservation"], "reservation"), r(a["spread"], "spread"))


@R.add()
def e28_execution_paths(spark, sf_dir):
    grid = spark.createDataFrame([(x,) for x in (0.0, 1e-7, 1e-6, 1e-5)], "aversion double")
    p = models.almgren_chriss(F.lit(1e6), F.lit(5.0), 5, F.lit(0.95), F.lit(2.5e-6), F.lit(2.5e-7), F.col("aversion"))
    return grid.select("aversion", p.alias("p")).select("aversion", F.round("p.cost", 4).alias("cost"), F.round("p.variance", 0).alias("variance"), F.transform("p.holdings", lambda x: F.round(x, 2)).alias("holdings"))


@R.add(ad.sql(f"select symbol, ts_us // {DAY_US} * {DAY_US} as start_us, event_type, count(*) as n, cast(sum(v) as bigint) as v from tape group by all", "tape"))
def g1_tumbling_windows(spark, sf_dir):
    return ad.tape(ad.events(spark, sf_dir)).groupBy("symbol", F.expr(f"ts_us div {DAY_US} * {DAY_US}").alias("start_us"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@R.add(ad.sql(f"with g as (select *, case when ts_us - lag(ts_us) over (partition by symbol order by seq) < {12 * HOUR_US} then 0 else 1 end as fresh from tape), s as (select *, sum(fresh) over (partition by symbol order by seq rows unbounded preceding) as sid from g) select symbol, min(ts_us) as start_us, max(ts_us) as last_us, count(*) as n from s group by symbol, sid", "tape"))
def g2_session_windows(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir)).withColumn("t", F.timestamp_micros("ts_us"))
    return t.groupBy("symbol", F.session_window("t", "12 hours")).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n")).select("symbol", "start_us", "last_us", "n")


@R.add(ad.sql("select symbol, side, price, cast(sum(dqty) as bigint) as qty from deltas group by all having sum(dqty) > 0 except select symbol, side, price, cast(sum(dqty) as bigint) as qty from deltas where seq <= 500 group by all having sum(dqty) > 0", "deltas"))
def set_levels_changed(spark, sf_dir):
    m, lives, _ = _log(spark, sf_dir)
    d = book.level_deltas(m, lives)
    return book.full_depth(d).exceptAll(book.full_depth(d, F.col("seq") <= 500))


@R.add(ad.sql("with m as (select symbol, ts_us, bid_px + ask_px as mid2 from bbo) select t.symbol, t.seq, f.mid2 as next_mid2 from trades t asof left join m f on t.symbol = f.symbol and t.ts_us < f.ts_us", "trades"))
def j5_next_quote(spark, sf_dir):
    from tickloom.operators.asof import asof

    q = ad.bbo(ad.events(spark, sf_dir))
    later = q.select("symbol", "seq", "ts_us", micro.fm.mid2().alias("mid2"))
    return asof(ad.trades(q), later, on=["symbol"], left_time=F.col("ts_us"), right_time=F.col("ts_us"), values=["mid2"], prefix="next_", forward=True, allow_equal=False).select("symbol", "seq", "next_mid2")


@R.add(ad.sql("select n_name as nation, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as total from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey group by n_name"))
def j12_metadata_join(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o = read("orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    c = read("customer").select("c_custkey", "c_nationkey")
    named = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(read("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return named.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total"))


@R.add(ad.sql("with e as (select symbol, shares, case when seq % 4 = 0 then case when seq % 8 = 0 then 'N' else 'Y' end end as printable from messages where msg_type = 'E') select symbol, count(*) as n, cast(sum(shares) as bigint) as shares from e where printable is null or printable = 'Y' group by symbol", "messages"))
def p4_printable(spark, sf_dir):
    """Printed volume: of every fourth execution at a price of its own, half are marked not printable."""
    own = (F.col("msg_type") == "E") & (F.col("seq") % 4 == 0)
    m = _log(spark, sf_dir)[0]
    told = m.withColumn("printable", F.when(own, F.when(F.col("seq") % 8 == 0, "N").otherwise("Y"))).withColumn("msg_type", F.when(own, "C").otherwise(F.col("msg_type")))
    return told.where(fm.printable_only()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"))


@R.add(ad.sql("select symbol, seq, price * 100 * shares // 1000000 * 27800000 // 1000000 + least(8300000, 166 * shares) as fee from trades where dir < 0", "trades"))
def f10_sale_fees(spark, sf_dir):
    t = ad.trades(ad.bbo(ad.events(spark, sf_dir))).where("dir < 0")
    return t.select("symbol", "seq", fm.sale_fees("price", "shares", 27_800_000, 166, 8_300_000).alias("fee"))


@R.add(ad.sql("select seq, sha256(concat_ws('|', symbol, seq, v, event_type)) as digest from tape", "tape"))
def f11_row_digests(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    return t.select("seq", F.sha2(F.concat_ws("|", F.col("symbol").cast("string"), F.col("seq").cast("string"), F.col("v").cast("string"), "event_type"), 256).alias("digest"))


IDS = "case v % 4 when 0 then cast(seq as varchar) when 1 then repeat('7', 99 + cast(seq % 3 as int)) when 2 then event_type || chr(9) || cast(seq as varchar) else '' end"


@R.add(ad.sql(f"select seq, regexp_full_match(x, '[0-9]{{1,100}}') as good, regexp_replace(x, '[\\x00-\\x1F\\x7F]', ' ', 'g') as line from (select seq, {IDS} as x from tape)", "tape"))
def f12_ids(spark, sf_dir):
    t = ad.tape(ad.events(spark, sf_dir))
    k, text = F.col("v") % 4, F.col("seq").cast("string")
    x = F.when(k == 0, text).when(k == 1, F.expr("repeat('7', 99 + cast(seq % 3 as int))")).when(k == 2, F.concat("event_type", F.lit("\t"), text)).otherwise("")
    return t.select("seq", fm.valid_id(x).alias("good"), fm.one_line(x).alias("line"))


@R.add(ad.sql("select case when symbol % 5 = 0 then null else strftime(day, '%Y-%m-%d') end as day, count(*) as n from bars group by 1", "bars"))
def p11_dates_of_paths(spark, sf_dir):
    """Days told by folder names in two forms; a fifth of the names has none."""
    b = ad.bars(spark, sf_dir)
    form = F.when(F.col("symbol") % 2 == 0, F.date_format("day", "yyyyMMdd")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    path = F.concat(F.lit("store/AB_20129/"), F.when(F.col("symbol") % 5 == 0, "none").otherwise(F.concat(F.lit("day_"), form)), F.lit("/part_34200000"))
    return b.groupBy(fm.path_date(path).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
