"""Closed-form market models as column functions; paths are arrays made in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kyle(sigma_v: Column, sigma_u: Column) -> Column:
    """Insider's intensity beta, price impact lambda, and the insider's profit (the noise traders' loss)."""
    return F.struct((sigma_u / sigma_v).alias("beta"), (sigma_v / (2 * sigma_u)).alias("impact"), (sigma_v * sigma_u / 2).alias("insider_profit"))


def glosten_milgrom(low: Column, high: Column, p_high: Column, informed: Column) -> Column:
    """Zero-profit quotes when a share of traders knows the value: ask, bid, and beliefs after a buy or a sale."""
    with_, against = (1 + informed) / 2, (1 - informed) / 2
    buy = p_high * with_ / (p_high * with_ + (1 - p_high) * against)
    sell = p_high * against / (p_high * against + (1 - p_high) * with_)
    return F.struct((low + (high - low) * buy).alias("ask"), (low + (high - low) * sell).alias("bid"), buy.alias("after_buy"), sell.alias("after_sell"))


def glosten_milgrom_path(p_high: Column, informed: Column, buys: Column) -> Column:
    """Beliefs before each of a row's trades (an array of booleans) and after the last."""
    with_, against = (1 + informed) / 2, (1 - informed) / 2
    step = lambda p, b: F.when(b, p * with_ / (p * with_ + (1 - p) * against)).otherwise(p * against / (p * against + (1 - p) * with_))
    return F.aggregate(buys, F.array(p_high.cast("double")), lambda path, b: F.concat(path, F.array(step(F.element_at(path, -1), b))))


def almgren_chriss(shares: Column, horizon: Column, n: int, sigma: Column, eta: Column, gamma: Column, aversion: Column) -> Column:
    """Holdings at each of n intervals' ends, expected cost and variance; no aversion is a straight line."""
    tau = horizon / n
    adjusted = eta - gamma * tau / 2
    k2 = aversion * sigma * sigma / adjusted
    kappa = F.when(k2 > 0, F.acosh(k2 * tau * tau / 2 + 1) / tau).otherwise(0.0)
    times = F.sequence(F.lit(0), F.lit(n))
    hold = F.transform(times, lambda j: F.when(kappa > 0, shares * F.sinh(kappa * (horizon - j * tau)) / F.sinh(kappa * horizon)).otherwise(shares * (1 - j / F.lit(n))))
    steps = F.sequence(F.lit(1), F.lit(n))
    sold = F.aggregate(steps, F.lit(0.0), lambda s, j: s + F.pow(F.element_at(hold, j) - F.element_at(hold, j + 1), 2))
    held = F.aggregate(steps, F.lit(0.0), lambda s, j: s + F.pow(F.element_at(hold, j + 1), 2))
    return F.struct(hold.alias("holdings"), (gamma * shares * shares / 2 + adjusted / tau * sold).alias("cost"), (sigma * sigma * tau * held).alias("variance"))


def avellaneda_stoikov(mid: Column, inventory: Column, gamma: Column, sigma: Column, k: Column, left: Column) -> Column:
    """Reservation price and quotes for an inventory with some time left."""
    r = mid - inventory * gamma * sigma * sigma * left
    spread = gamma * sigma * sigma * left + 2 / gamma * F.log(1 + gamma / k)
    return F.struct(r.alias("reservation"), spread.alias("spread"), (r - spread / 2).alias("bid"), (r + spread / 2).alias("ask"))
