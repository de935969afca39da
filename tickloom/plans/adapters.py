"""Canonical market tables from a plain events table, by integer rules that any SQL engine can repeat.

The engine's operators take canonical tables (``tape``, ``bbo``, ``trades``, ``messages``, ``pm``) and do
not care where they come from; these adapters make them from ``events`` and ``lineitem``. ``CTES`` has
the same rules as SQL for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_PX, TICK = 100_000, 100


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def tape(raw: DataFrame) -> DataFrame:
    """symbol, seq, ts_us, v (hundredths of the value), event_type."""
    return raw.select(
        F.col("user_id").alias("symbol"), F.col("event_id").alias("seq"), micros("ts").alias("ts_us"),
        F.round(F.col("value") * 100).cast("long").alias("v"), "event_type",
    )


def per_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("seq")


def bbo(raw: DataFrame) -> DataFrame:
    """One quote per event: a walk of the bid, a spread of 1 to 3 ticks, sizes from the value."""
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    walk = F.sum(step).over(per_symbol().rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    bid = F.lit(BASE_PX).cast("long") + TICK * walk
    return tape(raw).select(
        "symbol", "seq", "ts_us", "v", "event_type", bid.alias("bid_px"), (bid + TICK * (1 + F.col("seq") % 3)).alias("ask_px"),
        (100 + F.col("v") % 900).alias("bid_qty"), (100 + F.col("v") * 7 % 900).alias("ask_qty"),
    )


def trades(quotes: DataFrame) -> DataFrame:
    """Prints at purchase events: dir, shares, price, hidden, with the quote in force."""
    direction = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    hidden = F.col("seq") % 5 == 0
    price = F.when(hidden, F.col("bid_px") + TICK // 2).when(direction > 0, F.col("ask_px")).otherwise(F.col("bid_px"))
    return quotes.where("event_type = 'purchase'").select("symbol", "seq", "ts_us", direction.cast("long").alias("dir"), (F.col("v") + 1).alias("shares"), price.alias("price"), hidden.alias("hidden"), "bid_px", "ask_px")


def messages(quotes: DataFrame) -> DataFrame:
    """An order flow, five messages to a chunk: an order that is reduced and replaced once, one that is
    replaced twice in a row, or one that is executed in full before another comes and goes."""
    rn = (F.row_number().over(per_symbol()) - 1).cast("long")
    numbered = quotes.withColumn("rn", rn).withColumn("chunk", F.expr("rn div 5")).withColumn("step", F.col("rn") % 5)
    chunk = Window.partitionBy("symbol", "chunk").orderBy("seq")
    first = numbered.withColumn("root", F.first("seq").over(chunk)).withColumn("c", F.first("v").over(chunk))
    whole = Window.partitionBy("symbol", "chunk")
    seq_of = lambda k: F.max(F.when(F.col("step") == k, F.col("seq"))).over(whole)
    middle = first.withColumn("s1", seq_of(1)).withColumn("s2", seq_of(2)).withColumn("s3", seq_of(3))
    buy = F.col("chunk") % 2 == 0
    step, form = F.col("step"), (F.col("chunk") % 3).cast("int")
    msg_type = F.substring(F.element_at(F.array(*map(F.lit, ("AEXUD", "AUUED", "AEEAD"))), form + 1), (step + 1).cast("int"), F.lit(1))
    middle = middle.withColumn("msg_type", msg_type)
    own = F.when((form == 1) & (step > 2), F.col("s2")).when((form == 1) & (step == 2), F.col("s1")).when((form != 1) & (step == 4), F.col("s3")).when((form == 2) & (step == 3), F.col("seq")).otherwise(F.col("root"))
    adds, moves = F.col("msg_type") == "A", F.col("msg_type") == "U"
    return middle.select(
        "symbol", "seq", "ts_us",
        "msg_type", own.alias("ref"), F.when(moves, F.col("seq")).alias("new_ref"), F.when(adds, F.when(buy, "B").otherwise("S")).alias("side"),
        F.when(adds, 2 * F.col("c") + 10).when(moves, F.col("c") + 5).when(F.col("msg_type") == "X", 1).when((form == 2) & (step == 2), F.col("c") + 9).when(F.col("msg_type") == "E", F.col("c") + 1).cast("long").alias("shares"),
        F.when(adds, F.when(buy, F.col("bid_px")).otherwise(F.col("ask_px"))).when(moves, F.when(buy, F.col("bid_px") - TICK).otherwise(F.col("ask_px") + TICK)).alias("price"),
    )


def prints(quotes: DataFrame) -> DataFrame:
    """Messages that touch no order: hidden prints and crosses at purchases, trading states at signups."""
    buys, k = F.col("event_type") == "purchase", F.col("seq") % 3
    return quotes.where("event_type in ('purchase', 'signup')").select(
        "symbol", "seq", "ts_us", F.when(~buys, "H").when(k == 0, "Q").otherwise("P").alias("msg_type"), F.when(buys & (k != 0), F.col("seq")).alias("ref"), F.lit(None).cast("long").alias("new_ref"), F.when(buys & (k != 0), "B").alias("side"),
        F.when(buys, F.col("v") + 1).alias("shares"), F.when(buys, F.col("ask_px")).alias("price"), F.when(~buys, F.when(k == 0, "T").when(k == 1, "Q").otherwise("H")).alias("state"),
    )


def pm_changes(raw: DataFrame) -> DataFrame:
    """Prediction-market level changes: token, grp, px (1 to 9999), size, buy."""
    t = tape(raw)
    return t.select((F.col("symbol") % 20).alias("token"), F.expr("(symbol % 20) div 2").alias("grp"), "seq", "ts_us", (1 + F.col("v") % 9999).alias("px"), F.col("v").alias("size"), F.col("event_type").isin("click", "signup").alias("buy"), (F.col("event_type") == "purchase").alias("is_trade"))


def pm_quotes(raw: DataFrame) -> DataFrame:
    """Best quotes of a token after each change: a bid in (0, 0.5] and an ask above it, by integer rule."""
    t = pm_changes(raw)
    bid = 2000 + F.col("px") % 3000
    return t.select("token", "grp", "seq", "ts_us", bid.alias("bid"), (bid + 1 + F.col("size") % 900).alias("ask"), (1 + F.col("size") % 500).alias("bid_size"), (1 + F.col("size") * 3 % 500).alias("ask_size"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints from order lines: symbol, day, shares, price in cents."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_partkey").alias("symbol"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("long").alias("shares"), F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("price"), F.col("l_returnflag").alias("flag"))


#: The same rules as SQL (a plain database's dialect), each building on the ones before it.
CTES = {
    "tape": "select user_id as symbol, event_id as seq, epoch_us(ts) as ts_us, cast(round(value * 100) as bigint) as v, event_type from events",
    "bbo": "select symbol, seq, ts_us, v, event_type, bid_px, bid_px + 100 * (1 + seq % 3) as ask_px, 100 + v % 900 as bid_qty, 100 + (v * 7) % 900 as ask_qty from (select *, cast(100000 + 100 * sum(case event_type when 'click' then 1 when 'view' then -1 else 0 end) over (partition by symbol order by seq rows unbounded preceding) as bigint) as bid_px from tape)",
    "trades": "select symbol, seq, ts_us, case when seq % 2 = 0 then 1 else -1 end as dir, v + 1 as shares, case when seq % 5 = 0 then bid_px + 50 when seq % 2 = 0 then ask_px else bid_px end as price, seq % 5 = 0 as hidden, bid_px, ask_px from bbo where event_type = 'purchase'",
    "prints": "select symbol, seq, case event_type when 'signup' then 7 else case when seq % 3 = 0 then 6 else 5 end end as kind, case when event_type = 'purchase' and seq % 3 <> 0 then seq else 0 end as id, case event_type when 'purchase' then v + 1 else 0 end as size, case event_type when 'purchase' then ask_px else case seq % 3 when 0 then 1 when 1 then 0 else -1 end end as price, case when event_type = 'purchase' and seq % 3 <> 0 then 1 else -1 end as dir from bbo where event_type in ('purchase', 'signup')",
    "numbered": "select *, rn // 5 as chunk, rn % 5 as step from (select *, row_number() over (partition by symbol order by seq) - 1 as rn from bbo)",
    "chunked": "select *, first_value(seq) over w as root, first_value(v) over w as c, max(case when step = 1 then seq end) over (partition by symbol, chunk) as s1, max(case when step = 2 then seq end) over (partition by symbol, chunk) as s2, max(case when step = 3 then seq end) over (partition by symbol, chunk) as s3, cast(chunk % 3 as int) as form, substr(case chunk % 3 when 0 then 'AEXUD' when 1 then 'AUUED' else 'AEEAD' end, cast(step + 1 as int), 1) as msg_type from numbered window w as (partition by symbol, chunk order by seq)",
    "messages": "select symbol, seq, ts_us, msg_type, case when form = 1 and step > 2 then s2 when form = 1 and step = 2 then s1 when form <> 1 and step = 4 then s3 when form = 2 and step = 3 then seq else root end as ref, case when msg_type = 'U' then seq end as new_ref, case when msg_type = 'A' then case when chunk % 2 = 0 then 'B' else 'S' end end as side, case msg_type when 'A' then 2 * c + 10 when 'U' then c + 5 when 'X' then 1 when 'E' then case when form = 2 and step = 2 then c + 9 else c + 1 end end as shares, case msg_type when 'A' then case when chunk % 2 = 0 then bid_px else ask_px end when 'U' then case when chunk % 2 = 0 then bid_px - 100 else ask_px + 100 end end as price from chunked",
    "pm": "select symbol % 20 as token, (symbol % 20) // 2 as grp, seq, ts_us, 1 + v % 9999 as px, v as size, event_type in ('click', 'signup') as buy, event_type = 'purchase' as is_trade from tape",
    "pmq": "select token, grp, seq, ts_us, 2000 + px % 3000 as bid, 2000 + px % 3000 + 1 + size % 900 as ask, 1 + size % 500 as bid_size, 1 + (size * 3) % 500 as ask_size from pm",
    "bars": "select l_partkey as symbol, cast(l_shipdate as date) as day, cast(l_quantity as bigint) as shares, cast(round(l_extendedprice / l_quantity * 100) as bigint) as price, l_returnflag as flag from lineitem",
    "chain": "select symbol, ref, ref as root, side from messages where msg_type = 'A' union all select m.symbol, m.new_ref, c.root, c.side from chain c join messages m on m.symbol = c.symbol and m.ref = c.ref where m.msg_type = 'U'",
    "lives": "select m.symbol, c.ref, c.side, m.price, m.shares, m.seq as add_seq, m.ts_us as add_ts, case m.msg_type when 'U' then m.ref end as parent_ref from messages m join chain c on c.symbol = m.symbol and c.ref = coalesce(m.new_ref, m.ref) where m.msg_type in ('A', 'U')",
    "spent": "select symbol, ref, min_by(seq, seq) as seq, min_by(ts_us, seq) as ts_us, min_by(msg_type, seq) as msg_type from (select m.*, l.shares as size, sum(m.shares) over (partition by m.symbol, m.ref order by m.seq rows unbounded preceding) as cut from messages m join lives l on l.symbol = m.symbol and l.ref = m.ref where m.msg_type in ('E', 'X')) where cut >= size group by symbol, ref",
    "ends": "select symbol, ref, max(case when msg_type in ('D', 'U') then seq end) as end_seq, max(case when msg_type in ('D', 'U') then ts_us end) as end_ts, max(case when msg_type in ('D', 'U') then msg_type end) as end_kind, coalesce(sum(case when msg_type = 'E' then shares end), 0) as executed, coalesce(sum(case when msg_type = 'X' then shares end), 0) as cancelled from messages where msg_type in ('E', 'X', 'D', 'U') group by symbol, ref",
    "orders_t": "select l.*, coalesce(e.end_seq, s.seq) as end_seq, coalesce(e.end_ts, s.ts_us) as end_ts, coalesce(e.end_kind, s.msg_type) as end_kind, cast(coalesce(e.executed, 0) as bigint) as executed, cast(coalesce(e.cancelled, 0) as bigint) as cancelled from lives l left join ends e on l.symbol = e.symbol and l.ref = e.ref left join spent s on l.symbol = s.symbol and l.ref = s.ref",
    "deltas": "select symbol, add_seq as seq, add_ts as ts_us, side, price, shares as dqty from orders_t union all select m.symbol, m.seq, m.ts_us, o.side, o.price, -m.shares from messages m join orders_t o on m.symbol = o.symbol and m.ref = o.ref where m.msg_type in ('E', 'X') union all select symbol, end_seq, end_ts, side, price, -(shares - executed - cancelled) from orders_t where end_kind in ('D', 'U')",
}
NEEDS = {
    "bbo": "tape", "trades": "bbo", "prints": "bbo", "numbered": "bbo", "chunked": "numbered", "messages": "chunked", "pm": "tape", "pmq": "pm",
    "chain": "messages", "lives": "chain", "spent": "lives", "ends": "messages", "orders_t": "lives spent ends", "deltas": "orders_t",
}


def sql(body: str, *tables: str) -> str:
    """A query over the named tables: their rules as CTEs, then the body (which may go on with its own)."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, "").split():
            need(n)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    own = body.lstrip()
    if not order:
        return own
    more = own[5:] if own.startswith("with ") else None
    ctes = ", ".join(f"{n} as ({CTES[n]})" for n in order)
    return f"with recursive {ctes}, {more}" if more else f"with recursive {ctes} {own}"
