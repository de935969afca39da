"""Order-book operators over a message log: order lives, level changes, depth at a moment, checks.

The log is legal if every reference lives and no reduction exceeds what remains; ``rejected`` lists the
messages that are not. Everything here is joins, windows and sums, dealt by (symbol, ref) or
(symbol, side, price); ``kernels.sweep`` gives the best quote after each message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import checkpointed


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"))


def dump(messages: DataFrame, skip: int, count: int) -> DataFrame:
    """Messages ``skip`` to ``skip + count`` in feed order, as text lines."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("seq", "symbol", "msg_type", "ref", "new_ref", "side", "shares", "price")]
    return messages.orderBy("seq").offset(skip).limit(count).select("seq", F.concat_ws("|", *fields).alias("line"))


def roots(messages: DataFrame) -> DataFrame:
    """(symbol, ref, root): the add at the start of each reference's chain of replaces."""
    adds = messages.where("msg_type in ('A', 'F')").select("symbol", "ref", F.col("ref").alias("root"))
    return adds.unionByName(_replace_roots(messages))


def _replace_roots(messages: DataFrame) -> DataFrame:
    """``roots`` of the references that a replace begins, by pointer jumping: a chain of n takes about log n rounds."""
    links = messages.where("msg_type = 'U'").select("symbol", F.col("new_ref").alias("ref"), F.col("ref").alias("root"))
    while True:
        up = links.select(F.col("symbol").alias("s"), F.col("ref").alias("r"), F.col("root").alias("further"))
        step = checkpointed(links.join(up, (F.col("symbol") == F.col("s")) & (F.col("root") == F.col("r")), "left").select("symbol", "ref", "root", "further"))
        links = step.select("symbol", "ref", F.coalesce("further", "root").alias("root"))
        if step.where("further is not null").isEmpty():
            return links


def order_lives(messages: DataFrame) -> DataFrame:
    """One row per reference: how it began and ended, what was executed and cancelled.

    A replace ends one reference and begins another with the side of its chain's first add. An order also
    ends with the message that takes the last of its shares.
    """
    begun = messages.where("msg_type in ('A', 'F', 'U')").select(
        "symbol", F.coalesce("new_ref", "ref").alias("ref"), F.col("side").alias("own_side"), "price", "shares", F.col("seq").alias("add_seq"), F.col("ts_us").alias("add_ts"), F.when(F.col("msg_type") == "U", F.col("ref")).alias("parent_ref")
    )
    sides = messages.where("msg_type in ('A', 'F')").select("symbol", F.col("ref").alias("root"), F.col("side").alias("root_side"))
    chained = _replace_roots(messages).join(sides, ["symbol", "root"]).select("symbol", "ref", "root_side")
    cut, gone = F.col("msg_type").isin("E", "C", "X"), F.col("msg_type").isin("D", "U")
    last = lambda which: F.max(F.when(which, F.struct("seq", "ts_us", "msg_type")))
    ended = messages.where("msg_type in ('E', 'C', 'X', 'D', 'U')").groupBy("symbol", "ref").agg(
        last(gone).alias("gone"), last(cut).alias("cut"),
        F.sum(F.when(F.col("msg_type").isin("E", "C"), F.col("shares"))).alias("executed"), F.sum(F.when(F.col("msg_type") == "X", F.col("shares"))).alias("cancelled"),
    )
    out = begun.join(chained, ["symbol", "ref"], "left").join(ended, ["symbol", "ref"], "left")
    out = out.withColumn("side", F.coalesce("own_side", "root_side")).withColumn("executed", F.coalesce("executed", F.lit(0))).withColumn("cancelled", F.coalesce("cancelled", F.lit(0)))
    end = F.coalesce("gone", F.when(F.col("executed") + F.col("cancelled") >= F.col("shares"), F.col("cut")))
    out = out.withColumn("end", end)
    return out.select("symbol", "ref", "side", "price", "shares", "add_seq", "add_ts", "parent_ref", F.col("end.seq").alias("end_seq"), F.col("end.ts_us").alias("end_ts"), F.col("end.msg_type").alias("end_kind"), "executed", "cancelled")


def level_deltas(messages: DataFrame, lives: DataFrame) -> DataFrame:
    """Signed share changes of price levels: symbol, seq, ts_us, side, price, dqty."""
    added = lives.select("symbol", F.col("add_seq").alias("seq"), F.col("add_ts").alias("ts_us"), "side", "price", F.col("shares").alias("dqty"))
    reduced = messages.where("msg_type in ('E', 'C', 'X')").select("symbol", "seq", "ts_us", "ref", F.col("shares").alias("less"))
    reduced = reduced.join(lives.select("symbol", "ref", "side", "price"), ["symbol", "ref"]).select("symbol", "seq", "ts_us", "side", "price", (-F.col("less")).alias("dqty"))
    gone = lives.where("end_kind in ('D', 'U')").select("symbol", F.col("end_seq").alias("seq"), F.col("end_ts").alias("ts_us"), "side", "price", (-(F.col("shares") - F.col("executed") - F.col("cancelled"))).alias("dqty"))
    return added.unionByName(reduced).unionByName(gone)


def running_levels(deltas: DataFrame) -> DataFrame:
    """The quantity of a level after each message that touches it, and before (the queue that an add joins)."""
    merged = deltas.groupBy("symbol", "seq", "side", "price").agg(F.sum("dqty").alias("dqty"))
    w = Window.partitionBy("symbol", "side", "price").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return merged.withColumn("qty", F.sum("dqty").over(w)).withColumn("ahead", F.col("qty") - F.col("dqty"))


def full_depth(deltas: DataFrame, until: Column | None = None) -> DataFrame:
    """Resting shares by symbol, side and price (of the changes that meet ``until``)."""
    picked = deltas if until is None else deltas.where(until)
    return picked.groupBy("symbol", "side", "price").agg(F.sum("dqty").alias("qty")).where("qty > 0")


def book_at(deltas: DataFrame, ts_us: int, levels: int) -> DataFrame:
    """The best levels of both sides of every symbol at a time (messages at that time included)."""
    depth = full_depth(deltas, F.col("ts_us") <= ts_us)
    better = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    level = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(better)).cast("long")
    return depth.withColumn("level", level).where(F.col("level") <= levels)


def snapshots(deltas: DataFrame, every: int) -> DataFrame:
    """Depth after each ``every`` messages: snapshot (its last seq), symbol, side, price, qty."""
    # a change counts in its own and all later snapshots: sum within each, then a running sum over them
    part = deltas.groupBy(F.expr(f"seq div {every}").alias("block"), "symbol", "side", "price").agg(F.sum("dqty").alias("d"))
    w = Window.partitionBy("symbol", "side", "price").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return part.select(((F.col("block") + 1) * every - 1).alias("snapshot"), "symbol", "side", "price", F.sum("d").over(w).alias("qty"))


def rolled_forward(snaps: DataFrame, deltas: DataFrame, every: int, until_seq: int) -> DataFrame:
    """Depth at a message number from each level's last snapshot before it and the changes since."""
    last = (until_seq + 1) // every * every - 1
    w = Window.partitionBy("symbol", "side", "price").orderBy(F.desc("snapshot"))
    base = snaps.where(F.col("snapshot") <= last).withColumn("r", F.row_number().over(w)).where("r = 1").select("symbol", "side", "price", F.col("qty").alias("dqty"))
    since = deltas.where((F.col("seq") > last) & (F.col("seq") <= until_seq)).select("symbol", "side", "price", "dqty")
    return full_depth(base.unionByName(since))


def conservation(lives: DataFrame) -> DataFrame:
    """Shares added = executed + cancelled + removed + resting, by symbol."""
    rest = F.col("shares") - F.col("executed") - F.col("cancelled")
    return lives.groupBy("symbol").agg(
        F.sum("shares").alias("added"), F.sum("executed").alias("executed"), F.sum("cancelled").alias("cancelled"),
        F.sum(F.when(F.col("end_seq").isNotNull(), rest).otherwise(0)).alias("removed"), F.sum(F.when(F.col("end_seq").isNull(), rest).otherwise(0)).alias("resting"),
    ).withColumn("balanced", F.col("added") == F.col("executed") + F.col("cancelled") + F.col("removed") + F.col("resting"))


def rejected(messages: DataFrame, lives: DataFrame) -> DataFrame:
    """Messages that a book refuses: no such live reference, nothing to reduce, or more than remains."""
    w = Window.partitionBy("symbol", "ref").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    less = F.when(F.col("msg_type").isin("E", "C", "X"), F.col("shares")).otherwise(0)
    acts = messages.where("msg_type in ('E', 'C', 'X', 'D', 'U')").withColumn("before", F.coalesce(F.sum(less).over(w), F.lit(0)))
    known = lives.select("symbol", "ref", F.col("shares").alias("size"), "add_seq", "end_seq")
    judged = acts.join(known, ["symbol", "ref"], "left")
    why = F.when(F.col("add_seq").isNull() | (F.col("seq") <= F.col("add_seq")) | (F.col("seq") > F.col("end_seq")), "unknown").when((less == 0) & F.col("msg_type").isin("E", "C", "X"), "empty").when(F.col("before") + less > F.col("size"), "too_many")
    return judged.withColumn("reason", why).where("reason is not null").select("symbol", "seq", "msg_type", "ref", "reason")


def remaining(messages: DataFrame, lives: DataFrame) -> DataFrame:
    """Shares left of an order after each of its reductions."""
    w = Window.partitionBy("symbol", "ref").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cuts = messages.where("msg_type in ('E', 'C', 'X')").withColumn("cut", F.sum("shares").over(w))
    return cuts.join(lives.select("symbol", "ref", F.col("shares").alias("size")), ["symbol", "ref"]).select("symbol", "seq", "ref", (F.col("size") - F.col("cut")).alias("left"))


def lifetimes(lives: DataFrame, edges_us: tuple[int, ...]) -> DataFrame:
    """Orders by how long they lived (bins closed below), how many traded, and how many still rest."""
    age = F.col("end_ts") - F.col("add_ts")
    label = F.lit(len(edges_us))
    for k in reversed(range(len(edges_us))):
        label = F.when(age < edges_us[k], k).otherwise(label)
    return lives.withColumn("bin", F.when(F.col("end_ts").isNull(), -1).otherwise(label).cast("long")).groupBy("bin").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.when(F.col("executed") > 0, 1).otherwise(0)).alias("traded"))


def replay_stats(messages: DataFrame, lives: DataFrame) -> DataFrame:
    """Per symbol: messages, executed shares, and the most orders alive at once."""
    alive = lives.select("symbol", F.col("add_seq").alias("seq"), F.lit(1).alias("d")).union(lives.where("end_seq is not null").select("symbol", "end_seq", F.lit(-1)))
    merged = alive.groupBy("symbol", "seq").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    peak = merged.withColumn("n", F.sum("d").over(w)).groupBy("symbol").agg(F.max("n").alias("max_orders"))
    totals = messages.groupBy("symbol").agg(F.count(F.lit(1)).alias("msgs"), F.sum(F.when(F.col("msg_type") == "E", F.col("shares")).otherwise(0)).alias("executed"))
    return totals.join(peak, "symbol")


def invariants(deltas: DataFrame, lives: DataFrame) -> DataFrame:
    """Counts of broken rules: negative levels at any time, and levels that differ from their orders' sum at the end."""
    negative = running_levels(deltas).where("qty < 0").select(F.lit("negative_level").alias("rule"))
    ends = full_depth(deltas).select("symbol", "side", "price", "qty")
    sums = lives.where("end_seq is null").groupBy("symbol", "side", "price").agg(F.sum(F.col("shares") - F.col("executed") - F.col("cancelled")).alias("want")).where("want > 0")
    differ = ends.join(sums, ["symbol", "side", "price"], "full_outer").where("not (qty <=> want)").select(F.lit("level_sum").alias("rule"))
    rules = deltas.sparkSession.createDataFrame([("negative_level",), ("level_sum",)], "rule string")
    return rules.join(negative.union(differ).groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("broken"))


def lobster(messages: DataFrame, lives: DataFrame) -> DataFrame:
    """Level-book export rows: 1 add, 2 partial cancel, 3 delete, 4 execution, 5 hidden print, 6 cross, 7 halt state.

    A replace is a 3 and then a 1. Crosses and states have id 0 and direction -1; the price of a state is
    1 (trading), 0 (quotes only) or -1. Messages without a ``state`` column have no states.
    """
    known = lives.select("symbol", "ref", F.col("side").alias("own_side"), F.col("price").alias("own_price"), (F.col("shares") - F.col("executed") - F.col("cancelled")).alias("own_left"))
    joined = messages.join(known, ["symbol", "ref"], "left")
    sign = F.when(F.col("msg_type").isin("Q", "H"), -1).when(F.coalesce("side", "own_side") == "B", 1).otherwise(-1)
    none = F.lit(0).cast("long")
    state = F.col("state") if "state" in messages.columns else F.lit(None)
    traded = F.when(state == "T", 1).when(state == "Q", 0).otherwise(-1).cast("long")
    row = lambda kind, ref, size, price: F.struct(F.lit(kind).alias("kind"), ref.alias("id"), size.alias("size"), price.alias("price"))
    gone = row(3, F.col("ref"), F.col("own_left"), F.col("own_price"))
    rows = (
        F.when(F.col("msg_type").isin("A", "F"), F.array(row(1, F.col("ref"), F.col("shares"), F.col("price"))))
        .when(F.col("msg_type") == "X", F.array(row(2, F.col("ref"), F.col("shares"), F.col("own_price"))))
        .when(F.col("msg_type") == "D", F.array(gone))
        .when(F.col("msg_type").isin("E", "C"), F.array(row(4, F.col("ref"), F.col("shares"), F.col("own_price"))))
        .when(F.col("msg_type") == "U", F.array(gone, row(1, F.col("new_ref"), F.col("shares"), F.col("price"))))
        .when(F.col("msg_type") == "P", F.array(row(5, F.coalesce("ref", none), F.col("shares"), F.col("price"))))
        .when(F.col("msg_type") == "Q", F.array(row(6, none, F.col("shares"), F.col("price"))))
        .when(F.col("msg_type") == "H", F.array(row(7, none, none, traded)))
    )
    told = joined.select("symbol", "seq", "ts_us", sign.alias("dir"), F.posexplode(rows).alias("part", "r"))
    return told.select("symbol", "seq", "ts_us", F.col("part").cast("long").alias("part"), F.col("r.kind").cast("long").alias("kind"), F.col("r.id").alias("id"), F.col("r.size").alias("size"), F.col("r.price").alias("price"), F.col("dir").cast("long").alias("dir"))
