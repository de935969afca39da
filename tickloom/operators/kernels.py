"""Folds that windows cannot express, one pass per key over sorted rows with state that is carried on.

``fold`` sorts within partitions and streams them, so a key of any length is read batch by batch and
memory holds the state alone. A kernel is a class: ``start()`` at a key's first row, ``step(row)`` for
each row, returning the values to add.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.session import ensure_importable


def fold(df: DataFrame, by: list[str], order: list[str], kernel: Callable[[], object], added: str) -> DataFrame:
    """df's rows with the columns that the kernel adds (``added``: DDL); rows of a key come in order."""
    ensure_importable(df.sparkSession)
    extra = StructType.fromDDL(added)
    schema = StructType(df.schema.fields + extra.fields)
    names, new = df.columns, extra.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = kernel(), object()
        for batch in batches:
            out = []
            columns = {c: batch.column(c).to_pylist() for c in names}
            keys = list(zip(*(columns[c] for c in by), strict=True)) if by else [()] * batch.num_rows
            for i in range(batch.num_rows):
                if keys[i] != key:
                    key = keys[i]
                    state.start()
                out.append(state.step({c: columns[c][i] for c in names}))
            arrays = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, *new])

    dealt = df.repartition(*by) if by else df.coalesce(1)
    return dealt.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class Ewma:
    """v = keep * v + (1 - keep) * x from the first x on; null x leaves it. Gives the value before and after."""

    def __init__(self, column: str, keep: float) -> None:
        self.column, self.keep = column, keep

    def start(self) -> None:
        self.v = None

    def step(self, row: dict) -> tuple:
        before, x = self.v, row[self.column]
        if x is not None:
            self.v = x if self.v is None else self.keep * self.v + (1 - self.keep) * x
        return before, self.v


def ewma(df: DataFrame, by: list[str], order: list[str], column: str, keep: float) -> DataFrame:
    return fold(df, by, order, lambda: Ewma(column, keep), f"{column}_before double, {column}_ewma double")


class Burst:
    """Numbers bursts that last a fixed time from their first row."""

    def __init__(self, time: str, span: int) -> None:
        self.time, self.span = time, span

    def start(self) -> None:
        self.number, self.begun = -1, None

    def step(self, row: dict) -> tuple:
        if self.begun is None or row[self.time] - self.begun > self.span:
            self.number, self.begun = self.number + 1, row[self.time]
        return (self.number,)


def bursts(df: DataFrame, by: list[str], time: str, seq: str, span: int) -> DataFrame:
    return fold(df, by, [time, seq], lambda: Burst(time, span), "burst long")


class Bucket:
    """A token bucket: admits a row if a token is there; ``rate`` per second, at most ``size``."""

    def __init__(self, time: str, rate: float, size: float) -> None:
        self.time, self.rate, self.size = time, rate, size

    def start(self) -> None:
        self.tokens, self.at = self.size, None

    def step(self, row: dict) -> tuple:
        now = row[self.time]
        if self.at is not None:
            self.tokens = min(self.size, self.tokens + (now - self.at) * 1e-6 * self.rate)
        self.at = now
        ok = self.tokens >= 1
        self.tokens -= ok
        return (ok,)


def throttle(df: DataFrame, by: list[str], time: str, seq: str, rate: float, size: float) -> DataFrame:
    return fold(df, by, [time, seq], lambda: Bucket(time, rate, size), "admitted boolean")


class Levels:
    """One side's price levels with the best on top of a heap; emptied levels leave it lazily."""

    def __init__(self, sign: int) -> None:
        self.sign, self.qty, self.heap = sign, {}, []

    def add(self, price: int, d: int) -> None:
        q = self.qty.get(price, 0) + d
        if price not in self.qty and q > 0:
            heapq.heappush(self.heap, self.sign * price)
        if q > 0:
            self.qty[price] = q
        else:
            self.qty.pop(price, None)

    def best(self) -> tuple[int, int] | None:
        while self.heap:
            p = self.heap[0] * self.sign
            if p in self.qty:
                return p, self.qty[p]
            heapq.heappop(self.heap)
        return None

    def top(self, n: int) -> list[tuple[int, int]]:
        return [(p, self.qty[p]) for p in sorted(self.qty, key=lambda p: self.sign * p)[:n]]


class BookState:
    """The book of a symbol with the exact rules: an act on an unknown reference, of nothing, or of more than is left is refused."""

    def start(self) -> None:
        self.orders: dict[int, list] = {}
        self.sides = {"B": Levels(-1), "S": Levels(1)}

    def add(self, ref: int, side: str, shares: int, price: int) -> bool:
        if ref in self.orders or shares <= 0 or side not in self.sides:
            return False
        self.orders[ref] = [side, price, shares]
        self.sides[side].add(price, shares)
        return True

    def reduce(self, ref: int, shares: int) -> bool:
        o = self.orders.get(ref)
        if o is None or shares <= 0 or shares > o[2]:
            return False
        o[2] -= shares
        self.sides[o[0]].add(o[1], -shares)
        if not o[2]:
            del self.orders[ref]
        return True

    def erase(self, ref: int) -> bool:
        o = self.orders.get(ref)
        return o is not None and self.reduce(ref, o[2])

    def replace(self, ref: int, new_ref: int, shares: int, price: int) -> bool:
        o = self.orders.get(ref)
        if o is None or new_ref in self.orders or shares <= 0:
            return False
        self.erase(ref)
        return self.add(new_ref, o[0], shares, price)

    def apply(self, m: dict) -> bool:
        kind = m["msg_type"]
        if kind in ("A", "F"):
            return self.add(m["ref"], m["side"], m["shares"], m["price"])
        if kind in ("E", "C", "X"):
            return self.reduce(m["ref"], m["shares"])
        if kind == "D":
            return self.erase(m["ref"])
        if kind == "U":
            return self.replace(m["ref"], m["new_ref"], m["shares"], m["price"])
        return True

    def step(self, row: dict) -> tuple:
        ok = self.apply(row)
        b, a = self.sides["B"].best(), self.sides["S"].best()
        return (ok, *(b or (None, None)), *(a or (None, None)))


QUOTE = "ok boolean, bid_px long, bid_qty long, ask_px long, ask_qty long"


def sweep(messages: DataFrame) -> DataFrame:
    """Best quotes after every message, and whether the book took it."""
    return fold(messages, ["symbol"], ["seq"], BookState, QUOTE)


class DepthState(BookState):
    def __init__(self, n: int) -> None:
        self.n = n

    def step(self, row: dict) -> tuple:
        ok = self.apply(row)
        return (ok, *([{"px": p, "qty": q} for p, q in self.sides[s].top(self.n)] for s in "BS"))


def depth_sweep(messages: DataFrame, levels: int) -> DataFrame:
    """The best levels of both sides after every message, as arrays."""
    level = "array<struct<px: long, qty: long>>"
    return fold(messages, ["symbol"], ["seq"], lambda: DepthState(levels), f"ok boolean, bids {level}, asks {level}")


#: The feature columns, in order.
FEATURES = (
    "spread", "imbalance", "depth_ratio", "ofi_fast", "ofi_slow", "flow_fast", "flow_slow", "buy_rate", "sell_rate", "add_rate", "cancel_rate", "trade_rate",
    "cancel_share", "vol_fast", "vol_slow", "momentum_fast", "momentum_slow", "micro_gap", "log_since_spread", "log_since_trade", "log_last_trade", "hidden_imbalance", "time_of_day",
)


class Features:
    """Decayed features of a symbol's event stream: rates and flows by clock time, averages by event count.

    Rows: ts_us, event_type-like ``kind`` (add, cancel, trade, hidden), dir, shares, and the quote after.
    """

    def __init__(self, fast_us: float = 1e6, slow_us: float = 1e7, events: float = 50.0) -> None:
        self.fast, self.slow, self.w = fast_us, slow_us, 1 - 2 ** (-1 / events)

    def start(self) -> None:
        self.at = None
        self.sum = dict.fromkeys(("flow_fast", "flow_slow", "buy_rate", "sell_rate", "add_rate", "cancel_rate", "trade_rate", "vol_fast", "vol_slow", "momentum_fast", "momentum_slow"), 0.0)
        self.ofi_fast = self.ofi_slow = self.hidden = self.hidden_all = self.last_trade = 0.0
        self.quote = self.spread_at = self.trade_at = None

    def step(self, r: dict) -> tuple:
        now = r["ts_us"]
        dt = 0 if self.at is None else now - self.at
        self.at = now
        for k in self.sum:
            self.sum[k] *= math.exp(-dt / (self.slow if k.endswith("slow") else self.fast))
        q = (r["bid_px"], r["bid_qty"], r["ask_px"], r["ask_qty"])
        ok = None not in q and q[2] > q[0]
        s = self.sum
        kind, shares, sign = r["kind"], r["shares"] or 0, r["dir"] or 0
        if kind == "trade":
            s["flow_fast"] += sign * shares
            s["flow_slow"] += sign * shares
            s["buy_rate" if sign > 0 else "sell_rate"] += 1
            s["trade_rate"] += 1
            self.trade_at, self.last_trade = now, float(shares)
        elif kind == "hidden":
            self.hidden = (1 - self.w) * self.hidden + self.w * sign * shares
            self.hidden_all = (1 - self.w) * self.hidden_all + self.w * shares
        elif kind in ("add", "cancel"):
            s[f"{kind}_rate"] += 1
        if ok and self.quote:
            p = self.quote
            e = (q[1] if q[0] >= p[0] else 0) - (p[1] if q[0] <= p[0] else 0) - (q[3] if q[2] <= p[2] else 0) + (p[3] if q[2] >= p[2] else 0)
            self.ofi_fast += self.w * (e - self.ofi_fast)
            self.ofi_slow += self.w / 10 * (e - self.ofi_slow)
            ret = math.log((q[0] + q[2]) / (p[0] + p[2]))
            for k in ("fast", "slow"):
                s[f"vol_{k}"] += ret * ret
                s[f"momentum_{k}"] += ret
            if q[2] - q[0] != p[2] - p[0]:
                self.spread_at = now
        if ok:
            self.quote = q
            if self.spread_at is None:
                self.spread_at = now
        b = self.quote
        spread = float(b[2] - b[0]) if b else None
        total = b[1] + b[3] if b else 0
        imb = (b[1] - b[3]) / total if total else None
        micro = (b[2] * b[1] + b[0] * b[3]) / total - (b[0] + b[2]) / 2 if total else None
        churn = s["add_rate"] + s["cancel_rate"]
        since = lambda t: math.log1p((now - t) * 1e-6) if t is not None else None
        return (
            spread, imb, math.log((b[1] + 1) / (b[3] + 1)) if b else None, self.ofi_fast, self.ofi_slow, s["flow_fast"], s["flow_slow"], s["buy_rate"], s["sell_rate"], s["add_rate"], s["cancel_rate"], s["trade_rate"],
            s["cancel_rate"] / churn if churn > 0 else 0.0, math.sqrt(s["vol_fast"]), math.sqrt(s["vol_slow"]), s["momentum_fast"], s["momentum_slow"], micro, since(self.spread_at), since(self.trade_at), math.log1p(self.last_trade),
            self.hidden / self.hidden_all if self.hidden_all > 0 else 0.0, (now % 86_400_000_000) / 86_400_000_000,
        )


def features(events: DataFrame, **how) -> DataFrame:
    """23 features after each event; they depend on earlier rows only."""
    return fold(events, ["symbol"], ["seq"], lambda: Features(**how), ", ".join(f"{f} double" for f in FEATURES))


def excitation(t: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of exp(-beta (t_i - t_j)) over the events before each, and the same weighted by t_i - t_j.

    Taken in blocks within which the exponentials stay finite, so that a block is two running sums.
    """
    a, b = np.empty(len(t)), np.empty(len(t))
    edges = np.flatnonzero(np.diff(np.floor(beta * (t - t[0]) / 600))) + 1
    carry = lag = 0.0
    last = t[0]
    for lo, hi in zip([0, *edges], [*edges, len(t)], strict=True):
        u = t[lo:hi] - t[lo]
        fade = math.exp(-beta * (t[lo] - last))
        carry, lag = carry * fade, (lag + carry * (t[lo] - last)) * fade
        grown = np.exp(beta * u)
        sums, moments = np.cumsum(grown), np.cumsum(u * grown)
        before, moved = carry + sums - grown, moments - u * grown
        a[lo:hi] = before / grown
        b[lo:hi] = (u * before + lag - moved) / grown
        end = u[-1]
        lag = (end * (carry + sums[-1]) + lag - moments[-1]) / grown[-1]
        carry = (carry + sums[-1]) / grown[-1]
        last = t[hi - 1]
    return a, b


#: Branching ratios end below this: the process is stationary.
MOST_BRANCHING = 1 - 1e-6


def hawkes_loglik(t: np.ndarray, horizon: float, mu: float, alpha: float, beta: float) -> float:
    """Log-likelihood of times under a self-exciting process with an exponential kernel."""
    if mu <= 0 or alpha < 0 or beta <= 0 or not len(t):
        return -math.inf
    a, _ = excitation(t, beta)
    return float(np.log(mu + alpha * a).sum()) - mu * horizon - alpha / beta * float((1 - np.exp(-beta * (horizon - t))).sum())


def fit_hawkes(t: np.ndarray, horizon: float, rounds: int = 500) -> tuple[float, float, float, float]:
    """(mu, alpha, beta, log-likelihood) by expectation-maximisation over who caused whom, from three memories.

    Each round shares every event between the base rate and the events before it, and takes the rates
    that the shares give. Fewer than 20 events, or no time, give nan.
    """
    best = (math.nan, math.nan, math.nan, -math.inf)
    if len(t) < 20 or horizon <= 0:
        return best
    rate = len(t) / horizon
    for memory in (0.2, 2.0, 20.0):
        mu, branching, beta, had = 0.5 * rate, 0.5, memory * rate, -math.inf
        for _ in range(rounds):
            a, b = excitation(t, beta)
            alpha = branching * beta
            total = mu + alpha * a
            left = horizon - t
            reached = float((1 - np.exp(-beta * left)).sum())
            now = float(np.log(total).sum()) - mu * horizon - branching * reached
            if now > best[3]:
                best = (mu, alpha, beta, now)
            if now - had < 1e-9 * (1 + abs(now)):
                break
            had = now
            caused, waited = float((alpha * a / total).sum()), float((alpha * b / total).sum())
            mu = float((mu / total).sum()) / horizon
            edge = branching * float((left * np.exp(-beta * left)).sum())
            branching = min(caused / max(reached, 1e-300), MOST_BRANCHING)
            if caused <= 0 or waited + edge <= 0:
                break
            beta = caused / (waited + edge)
    return best


def hawkes(times: DataFrame, by: list[str], least: int, horizon: float) -> DataFrame:
    """Fit per group of (by, t in seconds from the window's start) with at least ``least`` events.

    A window of events is one group; windows bound it.
    """
    ensure_importable(times.sparkSession)
    keep = times.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in times.schema if f.name in by) + ", n long, mu double, alpha double, beta double, branching double"

    def run(table: pa.Table) -> pa.Table:
        t = np.sort(np.asarray(table.column("t"), float))
        mu, alpha, beta, _ = fit_hawkes(t, horizon)
        keys = {c: [table.column(c)[0].as_py()] for c in by}
        return pa.table(keys | {"n": [len(t)], "mu": [mu], "alpha": [alpha], "beta": [beta], "branching": [alpha / beta]})

    return times.join(keep, by).groupBy(*by).applyInArrow(run, schema)


def block_bootstrap(curve: DataFrame, reps: int, seed: int) -> DataFrame:
    """Per run (run, step, x): 95% interval of the sum under circular blocks of about n^(1/3) steps, and P(loss)."""
    ensure_importable(curve.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("step")))
        x = np.asarray(table.column("x"), float)[order]
        n = len(x)
        if n < 2:
            return pa.table({"run": [table.column("run")[0].as_py()], "low": [math.nan], "high": [math.nan], "p_loss": [math.nan]})
        b = max(1, round(n ** (1 / 3)))
        blocks = -(-n // b)
        ring = np.concatenate([[0.0], np.cumsum(np.concatenate([x, x[: b + 1]]))])
        rng = np.random.default_rng(seed)
        starts = rng.integers(0, n, (reps, blocks))
        sizes = np.full(blocks, b)
        sizes[-1] = n - b * (blocks - 1)
        totals = np.sort((ring[starts + sizes] - ring[starts]).sum(axis=1))
        return pa.table({"run": [table.column("run")[0].as_py()], "low": [totals[int(0.025 * reps)]], "high": [totals[int(0.975 * reps) - 1]], "p_loss": [float((totals < 0).mean())]})

    return curve.groupBy("run").applyInArrow(run, "run long, low double, high double, p_loss double")
