"""Order-book queries over the message log that the events table gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import book
from tickloom.plans import adapters as ad
from tickloom.plans.registry import Registry

R = Registry()
DAY_US = 86_400_000_000
#: 2024-01-15 12:00 UTC in microseconds; the events run over January 2024.
NOON_US = 1_705_320_000_000_000


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.messages(ad.bbo(ad.events(spark, sf_dir)))


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _messages(spark, sf_dir)
    lives = book.order_lives(m)
    return m, lives, book.level_deltas(m, lives)


@R.add(ad.sql("select msg_type, count(*) as n from messages group by msg_type", "messages"))
def s12_message_counts(spark, sf_dir):
    return book.message_counts(_messages(spark, sf_dir))


@R.add(ad.sql("select seq, concat_ws('|', seq::varchar, symbol::varchar, msg_type, ref::varchar, coalesce(new_ref::varchar, ''), coalesce(side, ''), coalesce(shares::varchar, ''), coalesce(price::varchar, '')) as line from messages order by seq limit 200 offset 50", "messages"))
def s13_dump(spark, sf_dir):
    return book.dump(_messages(spark, sf_dir), 50, 200)


@R.add(ad.sql("select symbol, ref, side, price, shares, add_seq, add_ts, parent_ref, end_seq, end_ts, end_kind, executed, cancelled from orders_t", "orders_t"))
def j1_order_lives(spark, sf_dir):
    return book.order_lives(_messages(spark, sf_dir))


@R.add(ad.sql("select symbol, ref, root from chain", "chain"))
def j2_replace_chains(spark, sf_dir):
    return book.roots(_messages(spark, sf_dir))


@R.add(ad.sql("select symbol, seq, side, price, dqty, sum(dqty) over w::bigint as qty, (sum(dqty) over w - dqty)::bigint as ahead from (select symbol, seq, side, price, sum(dqty)::bigint as dqty from deltas group by all) window w as (partition by symbol, side, price order by seq rows unbounded preceding)".replace("sum(dqty) over w::bigint", "cast(sum(dqty) over w as bigint)").replace("(sum(dqty) over w - dqty)::bigint", "cast(sum(dqty) over w - dqty as bigint)"), "deltas"))
def w1_running_levels(spark, sf_dir):
    return book.running_levels(_book(spark, sf_dir)[2])


@R.add(ad.sql("select m.symbol, m.seq, m.ref, cast(o.shares - sum(m.shares) over (partition by m.symbol, m.ref order by m.seq rows unbounded preceding) as bigint) as left from messages m join orders_t o on m.symbol = o.symbol and m.ref = o.ref where m.msg_type in ('E', 'X')".replace("as left from", 'as "left" from'), "orders_t"))
def w2_remaining(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return book.remaining(m, book.order_lives(m))


@R.add(ad.sql("select symbol, side, price, cast(sum(dqty) as bigint) as qty from deltas group by all having sum(dqty) > 0", "deltas"))
def l4_full_depth(spark, sf_dir):
    return book.full_depth(_book(spark, sf_dir)[2])


BOOK_AT = f"select symbol, side, price, qty, level from (select *, row_number() over (partition by symbol, side order by case side when 'B' then -price else price end) as level from (select symbol, side, price, cast(sum(dqty) as bigint) as qty from deltas where ts_us <= {NOON_US} group by all having sum(dqty) > 0)) where level <= 5"


@R.add(ad.sql(BOOK_AT, "deltas"))
def l5_book_at(spark, sf_dir):
    m = _messages(spark, sf_dir).where(F.col("ts_us") <= NOON_US)  # later messages change nothing of that book
    return book.book_at(book.level_deltas(m, book.order_lives(m)), NOON_US, 5)


@R.add(ad.sql("select s.snapshot, d.symbol, d.side, d.price, cast(sum(d.dqty) as bigint) as qty from deltas d join (select distinct symbol, side, price, (seq // 500 + 1) * 500 - 1 as snapshot from deltas) s on s.symbol = d.symbol and s.side = d.side and s.price = d.price and d.seq <= s.snapshot group by all", "deltas"))
def s11_snapshots(spark, sf_dir):
    return book.snapshots(_book(spark, sf_dir)[2], 500)


@R.add(ad.sql("select symbol, side, price, cast(sum(dqty) as bigint) as qty from deltas where seq <= 789 group by all having sum(dqty) > 0", "deltas"))
def j15_snapshot_then_replay(spark, sf_dir):
    deltas = _book(spark, sf_dir)[2]
    return book.rolled_forward(book.snapshots(deltas, 100), deltas, 100, 789)


@R.add(ad.sql("select symbol, cast(sum(shares) as bigint) as added, cast(sum(executed) as bigint) as executed, cast(sum(cancelled) as bigint) as cancelled, cast(sum(case when end_seq is not null then shares - executed - cancelled else 0 end) as bigint) as removed, cast(sum(case when end_seq is null then shares - executed - cancelled else 0 end) as bigint) as resting, true as balanced from orders_t group by symbol", "orders_t"))
def a2_conservation(spark, sf_dir):
    return book.conservation(_book(spark, sf_dir)[1])


@R.add(ad.sql("select m.symbol, m.seq, m.msg_type, m.ref, 'unknown' as reason from messages m left join orders_t o on m.symbol = o.symbol and m.ref = o.ref where m.msg_type <> 'A' and o.ref is null", "orders_t"))
def l1_rejected(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return book.rejected(m, book.order_lives(m))


EDGES = (DAY_US // 4, DAY_US // 2, DAY_US, 2 * DAY_US, 4 * DAY_US)


@R.add(ad.sql("select cast(bin as bigint) as bin, count(*) as orders, cast(sum(case when executed > 0 then 1 else 0 end) as bigint) as traded from (select executed, case when end_ts is null then -1 " + " ".join(f"when end_ts - add_ts < {e} then {k}" for k, e in enumerate(EDGES)) + " else 5 end as bin from orders_t) group by bin", "orders_t"))
def a8_lifetimes(spark, sf_dir):
    return book.lifetimes(_book(spark, sf_dir)[1], EDGES)


@R.add(ad.sql("with alive as (select symbol, seq, sum(d) as d from (select symbol, add_seq as seq, 1 as d from orders_t union all select symbol, end_seq, -1 from orders_t where end_seq is not null) group by all), peak as (select symbol, max(n) as max_orders from (select symbol, sum(d) over (partition by symbol order by seq rows unbounded preceding) as n from alive) group by symbol) select m.symbol, count(*) as msgs, cast(sum(case when msg_type = 'E' then shares else 0 end) as bigint) as executed, cast(any_value(max_orders) as bigint) as max_orders from messages m join peak p on m.symbol = p.symbol group by m.symbol", "orders_t"))
def a1_replay_stats(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return book.replay_stats(m, book.order_lives(m))


@R.add("select * from (values ('negative_level', 0::bigint), ('level_sum', 0::bigint)) t(rule, broken)")
def l6_invariants(spark, sf_dir):
    _, lives, deltas = _book(spark, sf_dir)
    return book.invariants(deltas, lives)


@R.add(ad.sql("with m as (select m.*, o.side as own_side, o.price as own_price, o.shares - o.executed - o.cancelled as own_left from messages m left join orders_t o on m.symbol = o.symbol and m.ref = o.ref), e as (select *, case when coalesce(side, own_side) = 'B' then 1 else -1 end as dir from m) select symbol, seq, cast(0 as bigint) as part, cast(case msg_type when 'A' then 1 when 'X' then 2 when 'E' then 4 else 3 end as bigint) as kind, ref as id, case when msg_type in ('D', 'U') then own_left else shares end as size, case when msg_type = 'A' then price else own_price end as price, cast(dir as bigint) as dir from e union all select symbol, seq, 1, 1, new_ref, shares, price, dir from e where msg_type = 'U'", "orders_t"))
def l9_lobster_events(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return book.lobster(m, book.order_lives(m)).drop("ts_us")


@R.add(ad.sql("select symbol, seq, cast(0 as bigint) as part, cast(kind as bigint) as kind, id, size, price, cast(dir as bigint) as dir from prints", "prints"))
def l9_lobster_prints(spark, sf_dir):
    """Export rows of messages that touch no order."""
    q = ad.bbo(ad.events(spark, sf_dir))
    return book.lobster(ad.prints(q), book.order_lives(ad.messages(q))).drop("ts_us")
