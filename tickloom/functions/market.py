"""Scalar functions of quotes, prices and money, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid2(bid: str = "bid_px", ask: str = "ask_px") -> Column:
    """Twice the mid, which is an integer."""
    return F.col(bid) + F.col(ask)


def valid_quote(bid: str = "bid_px", ask: str = "ask_px") -> Column:
    return F.col(bid).isNotNull() & F.col(ask).isNotNull() & (F.col(bid) > 0) & (F.col(ask) > F.col(bid))


def ofi(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column, bid0: Column, bid_qty0: Column, ask0: Column, ask_qty0: Column) -> Column:
    """Order-flow imbalance of one quote after another: demand added at the bid less supply added at the ask."""
    side = lambda test, q: F.when(test, q).otherwise(0)
    return side(bid >= bid0, bid_qty) - side(bid <= bid0, bid_qty0) - side(ask <= ask0, ask_qty) + side(ask >= ask0, ask_qty0)


def imbalance_bucket(bid_qty: str, ask_qty: str, buckets: int) -> Column:
    """floor(bid / (bid + ask) * buckets), at most buckets - 1, in integers."""
    return F.least(F.expr(f"({bid_qty} * {buckets}) div ({bid_qty} + {ask_qty})"), F.lit(buckets - 1))


def state_of(buckets: int, spreads: int, tick: int) -> Column:
    """Imbalance bucket and spread in ticks (whole ticks from 1 to spreads only, else null)."""
    spread = F.col("ask_px") - F.col("bid_px")
    ok = (spread % tick == 0) & (spread >= tick) & (spread <= spreads * tick)
    return F.when(ok, imbalance_bucket("bid_qty", "ask_qty", buckets) + buckets * (F.expr(f"(ask_px - bid_px) div {tick}") - 1))


def capped_state(buckets: int, spreads: int, tick: int) -> Column:
    """As state_of, but the spread is rounded to the nearest tick and capped; an invalid quote has none."""
    ticks = F.least(F.greatest(F.floor((F.col("ask_px") - F.col("bid_px")) / tick + 0.5), F.lit(1)), F.lit(spreads))
    return F.when(valid_quote() & (F.col("bid_qty") + F.col("ask_qty") > 0), (ticks - 1) * buckets + imbalance_bucket("bid_qty", "ask_qty", buckets)).cast("long")


def size_bucket(shares: str = "shares") -> Column:
    s = F.col(shares)
    return F.when(s <= 100, "1-100").when(s <= 500, "101-500").when(s <= 2000, "501-2000").otherwise("over 2000")


def trade_sign(price: str = "price") -> Column:
    """+1 above the mid, -1 below, 0 at it."""
    return F.signum(2 * F.col(price) - mid2()).cast("long")


def clock_to_ns(text: Column) -> Column:
    """HH:MM:SS with up to nine decimals, as nanoseconds since midnight; null if it is not a time."""
    p = r"^(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?$"
    part = lambda k: F.regexp_extract(text, p, k)
    seconds = part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")
    return F.when(text.rlike(p), seconds * 1_000_000_000 + F.coalesce(F.rpad(part(4), 9, "0").cast("long"), F.lit(0)))


def ns_to_clock(ns: Column) -> Column:
    """HH:MM:SS.mmm of nanoseconds since midnight."""
    s = F.floor(ns / 1_000_000_000)
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.floor(ns / 1_000_000) % 1000)


def pm_price(text: Column) -> Column:
    """A decimal in [0, 1] as 1e-4 units, digits past the fourth dropped; -1 if malformed or above 1."""
    p = r"^(\d*)(?:\.(\d*))?$"
    whole = F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("long"), F.lit(0))
    part = F.rpad(F.substring(F.regexp_extract(text, p, 2), 1, 4), 4, "0").cast("long")
    units = whole * 10_000 + part
    good = text.rlike(p) & text.rlike(r"\d") & (F.length(F.regexp_extract(text, p, 1)) <= 6)
    return F.when(good & (units <= 10_000), units).otherwise(-1)


def taker_fee(size: Column, price: Column, rate_ppm: Column, exponent: int) -> Column:
    """size (1e-6 shares) * rate * (p (1 - p))^exponent, half up to 1e-5 USD, as an exact integer of 1e-5 USD."""
    d = lambda c: c.cast("decimal(38,0)")
    curve = d(price) * d(10_000 - price)
    top, bottom = d(size) * d(rate_ppm), 10**6 * 10**6
    for _ in range(exponent):
        top, bottom = d(top * curve), bottom * 10**8
    top = d(top * 10**5)
    return F.floor(d(2 * top + F.lit(str(bottom)).cast("decimal(38,0)")) / F.lit(str(2 * bottom)).cast("decimal(38,0)")).cast("long")


def section31_fee(notional_usd: Column, ppm: int) -> Column:
    """Fee on sale notional in whole dollars, in micro-dollars."""
    return F.floor(notional_usd) * ppm


def sale_fees(price: str, shares: str, per_million: int, taf_share: int, taf_most: int) -> Column:
    """Regulatory fees of a sale in micro-dollars: so much a million of whole dollars sold, and so much a share up to a bound.

    price in 1e-4 dollars; both parts truncate to integers.
    """
    return F.expr(f"({price} * 100 * {shares}) div 1000000 * {per_million} div 1000000") + F.least(F.lit(taf_most), F.lit(taf_share) * F.col(shares))


def printable_only() -> Column:
    """Executions that count as prints: every E, and a C that is marked printable. The book applies the others too."""
    return (F.col("msg_type") == "E") | ((F.col("msg_type") == "C") & (F.col("printable") == "Y"))


def path_date(path: Column) -> Column:
    """The date in a file's or folder's name, as yyyy-mm-dd or yyyymmdd; the last one counts, null if there is none."""
    found = F.regexp_extract(path, r"^.*(?<!\d)((?:19|20)\d\d)-?(0[1-9]|1[0-2])-?(0[1-9]|[12]\d|3[01])(?!\d)", 0)
    day = F.regexp_replace(F.regexp_extract(found, r"(\d{4}-?\d{2}-?\d{2})$", 1), "-", "")
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyyMMdd")


def valid_id(text: Column) -> Column:
    """Whether an exchange's id is 1 to 100 decimal digits; null is not."""
    return F.coalesce(text.rlike(r"\A[0-9]{1,100}\z"), F.lit(False))


def one_line(text: Column) -> Column:
    """Control characters as spaces, so that a text stays one field of a tab-separated line."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")


def row_digest(*columns: str) -> Column:
    """A 64-bit digest of a row's values; null and an empty text differ."""
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])


def upper_tail(x: Column) -> Column:
    """1 - normal_cdf(x) for x >= 0, to double precision: a power series below 3, a continued fraction beyond."""
    x2 = x * x
    density = F.exp(-x2 / 2) / F.lit((2 * math.pi) ** 0.5)
    step = lambda acc, k: F.struct((acc["t"] * x2 / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * x2 / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), step, lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k / acc)
    return F.when(x < 3, 0.5 - density * series).otherwise(density / fraction)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to double precision in both tails."""
    x = x.cast("double")
    tail = upper_tail(F.abs(x))
    return F.when(x >= 0, 1 - tail).when(x < 0, tail)


def normal_quantile(p: Column) -> Column:
    """The inverse of normal_cdf on (0, 1), else null: Newton steps on the tail, which near the root from one side."""
    p = p.cast("double")
    q = F.least(p, 1 - p)
    density = lambda x: F.exp(-x * x / 2) / F.lit((2 * math.pi) ** 0.5)
    x = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0.0), lambda x, _: F.greatest(x + (upper_tail(x) - q) / density(x), F.lit(0.0)))
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -x).otherwise(x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
