"""Prediction-market recordings and session files, and the engine's text outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tickloom.functions.market import one_line, pm_price, valid_id

LEVEL = "array<struct<price: string, size: string>>"
EVENT = (
    f"event_type string, asset_id string, bids {LEVEL}, asks {LEVEL}, tick_size string, new_tick_size string, timestamp string, conn string, price string, size string, side string, "
    "price_changes array<struct<asset_id: string, price: string, size: string, side: string, best_bid: string, best_ask: string>>, winning_asset_id string, assets_ids array<string>"
)


def lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines "<receive_ns> <json>" of the hourly files below connection folders: conn, file, recv_ns, body."""
    text = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", "true").text(path)
    part = F.split("value", " ", 2)
    where = F.input_file_name()
    return text.select(F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("conn"), where.alias("file"), F.expr("try_cast(split(value, ' ', 2)[0] as bigint)").alias("recv_ns"), part[1].alias("body"))


def events(raw: DataFrame) -> DataFrame:
    """Decoded events: a line holds one object or an array of them; ``part`` numbers those of a line."""
    kind = StructType.fromDDL(EVENT)
    one, many = F.from_json("body", kind), F.from_json("body", ArrayType(kind))
    both = F.when(F.trim("body").startswith("["), many).otherwise(F.array(one))
    return raw.withColumn("e", both).select("conn", "recv_ns", F.posexplode("e").alias("part", "e")).where("e.event_type is not null")


def level_changes(decoded: DataFrame) -> DataFrame:
    """Snapshot and change levels as rows: conn, recv_ns, part, kind, token, buy, px, size, best_bid, best_ask.

    A snapshot's levels share a line and part and replace the book; a change sets one level's size.
    """
    e = F.col("e")
    row = lambda kind, token, buy, px, size, bid, ask: F.struct(F.lit(kind).alias("kind"), token.alias("token"), buy.alias("buy"), pm_price(px).alias("px"), size.cast("double").alias("size"), bid.alias("best_bid"), ask.alias("best_ask"))
    nothing = F.lit(None).cast("long")
    side = lambda c, buy: F.transform(e[c], lambda x: row("snapshot", e["asset_id"], F.lit(buy), x["price"], x["size"], nothing, nothing))
    changes = F.transform(e["price_changes"], lambda x: row("change", x["asset_id"], x["side"] == "BUY", x["price"], x["size"], pm_price(x["best_bid"]), pm_price(x["best_ask"])))
    told = F.when(e["event_type"] == "book", F.concat(F.coalesce(side("bids", True), F.array()), F.coalesce(side("asks", False), F.array()))).when(e["event_type"] == "price_change", changes)
    return decoded.select("conn", "recv_ns", "part", F.posexplode(told).alias("at", "r")).select("conn", "recv_ns", "part", "at", "r.*")


def trades(decoded: DataFrame) -> DataFrame:
    e = F.col("e")
    return decoded.where("e.event_type = 'last_trade_price'").select("conn", "recv_ns", "part", e["asset_id"].alias("token"), (e["side"] == "BUY").alias("buy"), pm_price(e["price"]).alias("px"), e["size"].cast("double").alias("size"))


def quality(raw: DataFrame) -> DataFrame:
    """Per connection: lines, lines that are no JSON or have no time, and the longest gap."""
    bad = F.col("recv_ns").isNull() | F.expr("try_parse_json(body) is null")
    gap = F.col("recv_ns") - F.lag("recv_ns").over(Window.partitionBy("conn").orderBy("recv_ns"))
    return raw.withColumn("bad", bad).withColumn("gap", gap).groupBy("conn").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("bad"), 1)).alias("bad"), F.max("gap").alias("max_gap_ns"))


def session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, groups) of a session file: lines "token id conn label ..." and "group name id...", tab-separated."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) > 1")
    get = lambda k: F.get("f", F.lit(k))
    tokens = rows.where("f[0] = 'token'").select(get(1).alias("token"), get(2).alias("conn"), get(3).alias("label"), get(4).cast("double").alias("tick"), get(5).cast("double").alias("min_qty"), (get(6) == "1").alias("neg_risk"), (get(7) == "1").alias("fees"), get(8).cast("long").alias("fee_rate_ppm"), get(9).cast("int").alias("fee_exp"), get(10).cast("long").alias("delay_ms"))
    groups = rows.where("f[0] = 'group'").select(get(1).alias("grp"), F.posexplode(F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0)))).alias("leg", "token"))
    unknown = groups.join(tokens.select("token"), "token", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("a group names a token that the session lacks")
    return tokens, groups


def write_session(tokens: DataFrame, groups: DataFrame, path: str) -> None:
    """A session's file again (inverse of session): tokens and then groups, each in order of name."""
    flag = lambda c: F.when(F.col(c), "1").otherwise("0")
    text = lambda c: F.coalesce(one_line(F.col(c).cast("string")), F.lit(""))
    bad = tokens.where(~valid_id(F.col("token")))
    if not bad.isEmpty():
        raise ValueError("a token's id is not 1 to 100 digits")
    told = tokens.select(F.lit(0).alias("part"), "token", F.concat_ws("\t", F.lit("token"), "token", *map(text, ("conn", "label", "tick", "min_qty")), flag("neg_risk"), flag("fees"), *map(text, ("fee_rate_ppm", "fee_exp", "delay_ms"))).alias("value"))
    legs = groups.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("leg", "token"))), lambda x: x["token"]).alias("legs"))
    named = legs.select(F.lit(1).alias("part"), F.col("grp").alias("token"), F.concat_ws("\t", F.lit("group"), text("grp"), "legs").alias("value"))
    told.union(named).orderBy("part", "token").select("value").coalesce(1).write.text(path)


def compact(spark: SparkSession, raw: str, out: str, codec: str = "gzip") -> DataFrame:
    """Writes the whole records of text recordings compressed and gives (lines, torn) counts.

    What a stop left behind is dropped: a line that is cut off or of zero bytes has no time or is no JSON. Files appear
    in ``out`` only when the job commits; the raw ones are left to the caller.
    """
    lines = spark.read.text(raw).where("value <> ''")
    whole = F.col("value").rlike(r"^\d+ ") & F.expr("try_parse_json(split(value, ' ', 2)[1]) is not null")
    lines.where(whole).write.option("compression", codec).text(out)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(~whole, 1)).alias("torn"))


def capped_universe(groups: DataFrame, cap: int) -> list[str]:
    """Names of the groups taken in order of (rank) until the next would pass the cap; later smaller ones may still fit.

    groups: (grp, rank, n), one row per group of a session, so the driver walks them.
    """
    taken, used = [], 0
    for r in groups.orderBy("rank").collect():
        if used + r["n"] <= cap:
            taken.append(r["grp"])
            used += r["n"]
    return taken


def write_lobster(rows: DataFrame, depth: DataFrame, path: str, levels: int) -> None:
    """Message and book CSVs by symbol: rows of book.lobster, and (symbol, seq, bids, asks) after each message."""
    seconds = F.format_string("%d.%09d", F.expr("ts_us div 1000000"), F.col("ts_us") % 1_000_000 * 1000)
    full = rows.join(depth, ["symbol", "seq"])
    level = lambda side, k, f, none: F.coalesce(F.get(side, F.lit(k))[f], F.lit(none))
    book = [c for k in range(levels) for c in (level("asks", k, "px", 9_999_999_999), level("asks", k, "qty", 0), level("bids", k, "px", -9_999_999_999), level("bids", k, "qty", 0))]
    told = full.select("symbol", "seq", "part", F.concat_ws(",", seconds, "kind", "id", "size", "price", "dir").alias("message"), F.concat_ws(",", *book).alias("book"))
    for name in ("message", "book"):
        told.repartition("symbol").sortWithinPartitions("symbol", "seq", "part").select("symbol", F.col(name).alias("value")).write.partitionBy("symbol").text(f"{path}/{name}")
