"""Matching, queue replay and backtests: deterministic kernels, one task per (run, symbol, day).

Closed loops cannot be split over time, so runs are what is parallel: ``sweep`` pairs parameter sets
with symbols and streams each pair's messages, in order, through one engine.
"""

from __future__ import annotations

import heapq
import itertools
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.kernels import BookState
from tickloom.session import ensure_importable

MARKET, DATA, ORDER, REPORT = range(4)  # at one time: exchange, then data arriving, orders arriving, reports


class Scheduler:
    """Events by (time, kind, insertion)."""

    def __init__(self) -> None:
        self.heap, self.n = [], 0

    def put(self, time: int, kind: int, what: object) -> None:
        heapq.heappush(self.heap, (time, kind, self.n, what))
        self.n += 1

    def until(self, time: int, kind: int) -> Iterator[tuple[int, int, object]]:
        while self.heap and self.heap[0][:2] <= (time, kind):
            t, k, _, what = heapq.heappop(self.heap)
            yield t, k, what


class Matching:
    """Price-time priority: limit, market, immediate-or-cancel and post-only orders, reduce and replace.

    stp (same owner meets): none, cancel_new, cancel_old, cancel_both, decrement. lock (a post-only
    order would trade): reject, slide. Events: (kind, ref, other, shares, price).
    """

    def __init__(self, stp: str = "none", lock: str = "reject", tick: int = 100) -> None:
        self.stp, self.lock, self.tick = stp, lock, tick
        self.sides = {"B": {}, "S": {}}  # price -> ordered refs
        self.orders: dict[int, list] = {}  # ref -> [owner, side, price, left]

    def best(self, side: str) -> int | None:
        book = self.sides[side]
        return (max(book) if side == "B" else min(book)) if book else None

    def _drop(self, ref: int) -> None:
        _, side, price, _ = self.orders.pop(ref)
        level = self.sides[side][price]
        del level[ref]
        if not level:
            del self.sides[side][price]

    def submit(self, ref: int, owner: int, side: str, shares: int, price: int | None = None, *, ioc: bool = False, post_only: bool = False) -> list[tuple]:
        """price None is a market order. Orders of no shares, or of a reference that lives, are rejected."""
        if shares <= 0 or ref in self.orders or price is not None and price <= 0:
            return [("reject", ref, None, shares, price)]
        out: list[tuple] = []
        other = "S" if side == "B" else "B"
        meets = lambda p: price is None or (p <= price if side == "B" else p >= price)
        if post_only and (p := self.best(other)) is not None and meets(p):
            if self.lock == "reject":
                return [("reject", ref, None, shares, price)]
            price = p - self.tick if side == "B" else p + self.tick
        while shares and (p := self.best(other)) is not None and meets(p):
            rest = next(iter(self.sides[other][p]))
            resting = self.orders[rest]
            if self.stp != "none" and resting[0] == owner:
                if self.stp == "decrement":
                    cut = min(shares, resting[3])
                    shares -= cut
                    out.append(("decrement", ref, rest, cut, p))
                    self._take(rest, cut)
                    continue
                if self.stp in ("cancel_old", "cancel_both"):
                    out.append(("cancel", rest, ref, resting[3], p))
                    self._drop(rest)
                if self.stp in ("cancel_new", "cancel_both"):
                    return [*out, ("cancel", ref, rest, shares, price)]
                continue
            n = min(shares, resting[3])
            shares -= n
            out.append(("fill", ref, rest, n, p))
            self._take(rest, n)
        if shares and (price is None or ioc):
            out.append(("cancel", ref, None, shares, price))
        elif shares:
            self.orders[ref] = [owner, side, price, shares]
            self.sides[side].setdefault(price, OrderedDict())[ref] = None
            out.append(("accept", ref, None, shares, price))
        return out

    def _take(self, ref: int, n: int) -> None:
        self.orders[ref][3] -= n
        if not self.orders[ref][3]:
            self._drop(ref)

    def cancel(self, ref: int, owner: int) -> list[tuple]:
        o = self.orders.get(ref)
        if o is None or o[0] != owner:
            return [("reject", ref, None, 0, None)]
        self._drop(ref)
        return [("cancel", ref, None, o[3], o[2])]

    def reduce(self, ref: int, owner: int, shares: int) -> list[tuple]:
        """Keeps the place in the queue."""
        o = self.orders.get(ref)
        if o is None or o[0] != owner or not 0 < shares < o[3]:
            return [("reject", ref, None, shares, None)]
        o[3] -= shares
        return [("reduce", ref, None, shares, o[2])]

    def replace(self, ref: int, owner: int, new_ref: int, price: int, shares: int, post_only: bool = False) -> list[tuple]:
        """A new order behind the queue; the old one goes even if the new one is rejected."""
        o = self.orders.get(ref)
        if o is None or o[0] != owner:
            return [("reject", ref, None, shares, price)]
        side = o[1]
        self._drop(ref)
        return [("cancel", ref, None, o[3], o[2]), *self.submit(new_ref, owner, side, shares, price, post_only=post_only)]


@dataclass
class Virtual:
    ref: int
    side: str
    price: int
    left: int
    ahead: int  # real shares at its price that came before it
    rank: tuple[int, int]


class ReplayExchange(BookState):
    """A recorded book with virtual orders in its queues.

    Ranks at a price follow references, which are given on receipt; a virtual order ranks behind every
    reference seen so far. An execution of a real order first fills the virtual orders that rank
    before it: at better prices (``through``), and, under the rule "queue", at its price. All of them
    share the execution's size (``diverted``). A hidden print fills what it reaches on either side,
    behind the displayed orders. A virtual order that crosses takes real orders, best first, each for
    what none of ours has taken from it.
    """

    def __init__(self, rule: str = "queue") -> None:
        if rule not in ("queue", "through"):
            raise ValueError(f"unknown fill rule {rule}")
        self.rule = rule

    def start(self) -> None:
        super().start()
        self.mine: dict[int, Virtual] = {}
        self.used: dict[int, int] = {}  # real reference -> shares that ours took
        self.seen, self.n = 0, 0
        self.counts = {"diverted": 0, "taken": 0, "through": 0, "hidden": 0}

    def quote(self) -> tuple:
        b, a = self.sides["B"].best(), self.sides["S"].best()
        return (*(b or (None, 0)), *(a or (None, 0)))

    def submit(self, ref: int, side: str, price: int, shares: int, *, ioc: bool = False, post_only: bool = False) -> list[tuple]:
        """Fills (ref, shares, price, maker) at once, if it crosses; the rest joins the queue unless immediate-or-cancel.

        A post-only order that would trade is refused: no fills, and no such order after.
        """
        other = "S" if side == "B" else "B"
        best = self.sides[other].best()
        crosses = best is not None and (best[0] <= price if side == "B" else best[0] >= price)
        if crosses and post_only:
            return []
        fills = []
        if crosses:
            met = sorted((o[1] if side == "B" else -o[1], r) for r, o in self.orders.items() if o[0] == other and (o[1] <= price if side == "B" else o[1] >= price))
            for _, r in met:
                n = min(shares, self.orders[r][2] - self.used.get(r, 0))
                if n <= 0:
                    continue
                self.used[r] = self.used.get(r, 0) + n
                self.counts["taken"] += n
                shares -= n
                fills.append((ref, n, self.orders[r][1], False))
                if not shares:
                    break
        if shares and not ioc:
            self.n += 1
            self.mine[ref] = Virtual(ref, side, price, shares, self.sides[side].qty.get(price, 0), (self.seen, self.n))
        return fills

    def cancel(self, ref: int) -> bool:
        return self.mine.pop(ref, None) is not None

    def queue_ahead(self, ref: int) -> int | None:
        return self.mine[ref].ahead if ref in self.mine else None

    def _fill(self, side: str, price: int, rank: tuple | None, shares: int, hidden: bool = False) -> list[tuple]:
        """Fills of virtual orders that rank before a trade, at most its shares; rank None is behind all."""
        sign, fills = -1 if side == "B" else 1, []
        for v in sorted((v for v in self.mine.values() if v.side == side), key=lambda v: (sign * v.price, v.rank)):
            through = sign * v.price < sign * price
            at = v.price == price and self.rule == "queue" and (rank is None or v.rank < rank)
            if not shares or not (through or at):
                continue
            n = min(shares, v.left)
            shares -= n
            v.left -= n
            self.counts["through"] += through
            self.counts["hidden"] += hidden
            fills.append((v.ref, n, v.price, True))
            if not v.left:
                del self.mine[v.ref]
        return fills

    def on_message(self, m: dict) -> list[tuple]:
        """Applies a recorded message; fills of virtual orders that it brings about."""
        kind, ref, fills = m["msg_type"], m["ref"], []
        o = self.orders.get(ref)
        if kind == "P":
            fills = self._fill("B", m["price"], None, m["shares"], True)
            return fills + self._fill("S", m["price"], None, m["shares"] - sum(f[1] for f in fills), True)
        if o is not None and kind in ("E", "C", "X", "D", "U"):
            side, price, left = o
            gone = left if kind in ("D", "U") else min(m["shares"] or 0, left)
            if kind in ("E", "C"):
                fills = self._fill(side, price, (ref, 0), gone)
                self.counts["diverted"] += sum(f[1] for f in fills)
        if self.apply(m) and o is not None and kind in ("E", "C", "X", "D", "U"):
            for v in self.mine.values():
                if v.side == side and v.price == price and v.rank > (ref, 0):
                    v.ahead -= min(v.ahead, gone)
            if ref not in self.orders:
                self.used.pop(ref, None)
        self.seen = max(self.seen, ref or 0, m.get("new_ref") or 0)
        return fills


@dataclass
class Limits:
    position: int = 1_000
    order: int = 500
    collar: int = 10_000  # price distance from the mid
    rate: float = 100.0  # orders a second
    loss: int | None = None  # in price units times shares; trading stops beyond

    def refusal(self, signed: int, price: int, mid: float | None, position: int, tokens: float, killed: bool) -> str | None:
        if killed:
            return "killed"
        if abs(signed) > self.order:
            return "size"
        if abs(position + signed) > self.position:
            return "position"
        if mid is not None and abs(price - mid) > self.collar:
            return "collar"
        return "rate" if tokens < 1 else None


@dataclass
class View:
    """What a strategy sees: its (delayed) quote, position and orders."""

    ts: int
    bid: int | None
    bid_qty: int
    ask: int | None
    ask_qty: int
    position: int
    params: dict
    memory: dict = field(default_factory=dict)


STRATEGIES: dict[str, Callable[[View], tuple[int | None, int | None]]] = {}


def strategy(name: str):
    """Registers a function from a view to wanted (bid, ask) prices; None wants no order on that side."""

    def put(f):
        STRATEGIES[name] = f
        return f

    return put


@strategy("zero")
def _zero(v: View):
    return None, None


@strategy("naive")
def _naive(v: View):
    """Joins both sides of the quote, up to the inventory bound."""
    most = v.params.get("max_position", 300)
    return v.bid if v.position < most else None, v.ask if v.position > -most else None


@strategy("imbalance")
def _imbalance(v: View):
    """Joins only the side that the book leans to."""
    if v.bid is None or v.ask is None:
        return None, None
    lean = (v.bid_qty - v.ask_qty) / max(1, v.bid_qty + v.ask_qty)
    edge, most = v.params.get("edge", 0.3), v.params.get("max_position", 300)
    return v.bid if lean > -edge and v.position < most else None, v.ask if lean < edge and v.position > -most else None


@strategy("microprice")
def _microprice(v: View):
    """As naive, but quotes a side only if the size-weighted mid does not run through it."""
    if v.bid is None or v.ask is None:
        return None, None
    micro = (v.bid * v.ask_qty + v.ask * v.bid_qty) / max(1, v.bid_qty + v.ask_qty)
    half, most = v.params.get("half", 0.0), v.params.get("max_position", 300)
    return v.bid if micro - v.bid >= half and v.position < most else None, v.ask if v.ask - micro >= half and v.position > -most else None


@strategy("avellaneda_stoikov")
def _stoikov(v: View):
    """Quotes around an inventory-shifted mid."""
    if v.bid is None or v.ask is None:
        return None, None
    g, s, k, left = (v.params.get(n, d) for n, d in (("gamma", 0.01), ("sigma", 100.0), ("k", 0.02), ("left", 1.0)))
    import math

    mid = (v.bid + v.ask) / 2 - v.position / 100 * g * s * s * left
    half = (g * s * s * left + 2 / g * math.log(1 + g / k)) / 2
    tick = v.params.get("tick", 100)
    return min(int((mid - half) // tick * tick), v.ask - tick), max(int(-(-(mid + half) // tick) * tick), v.bid + tick)


@strategy("random_passive")
def _random_passive(v: View):
    """Joins the best on one side, by turns of a small generator."""
    v.memory["s"] = (v.memory.get("s", 12345) * 1103515245 + 12345) % 2**31
    return (v.bid, None) if v.memory["s"] >> 16 & 1 else (None, v.ask)


class Backtest:
    """One run over one symbol's messages: delayed data, delayed orders and reports, risk, accounts.

    Latencies are in microseconds. Money is price units times shares.
    """

    def __init__(self, name: str, params: dict, data_us: int = 50, order_us: int = 50, report_us: int = 50, shares: int = 100, limits: Limits | None = None, fee: int = 0) -> None:
        self.decide, self.params = STRATEGIES[name], params
        self.delays, self.shares, self.limits, self.fee = (data_us, order_us, report_us), shares, limits or Limits(), fee
        self.exchange, self.queue = ReplayExchange(params.get("rule", "queue")), Scheduler()
        self.exchange.start()
        self.refs = itertools.count(1 << 39)
        self.working: dict[str, tuple[int, int] | None] = {"B": None, "S": None}
        self.position = self.cash = self.fees = self.orders = self.refused = 0
        self.tokens, self.token_at, self.killed, self.memory = self.limits.rate, None, False, {}
        self.fills: list[tuple] = []
        self.minutes: dict[int, int] = {}
        self.mid: float | None = None

    def message(self, m: dict) -> None:
        now = m["ts_us"]
        self._drain(now, MARKET - 1)
        fills = self.exchange.on_message(m)
        q = self.exchange.quote()
        if q[0] is not None and q[2] is not None and q[2] > q[0]:
            self.mid = (q[0] + q[2]) / 2
        self._filled(now, fills)
        self.minutes[now // 60_000_000] = self.total()
        self.queue.put(now + self.delays[0], DATA, q)

    def finish(self) -> None:
        self._drain(1 << 62, REPORT)

    def total(self) -> int:
        return int(self.cash - self.fees + self.position * (self.mid or 0))

    def _filled(self, now: int, fills: list[tuple]) -> None:
        for ref, n, price, maker in fills:
            side = next((s for s, w in self.working.items() if w and w[0] == ref), None) or self.memory.get(("side", ref))
            sign = 1 if side == "B" else -1
            self.position += sign * n
            self.cash -= sign * n * price
            self.fees += n * self.fee
            self.fills.append((now, sign * n, price, maker))
            self.queue.put(now + self.delays[2], REPORT, (ref, n))
        if self.limits.loss is not None and self.total() < -self.limits.loss:
            self.killed = True

    def _drain(self, time: int, kind: int) -> None:
        for now, k, what in self.queue.until(time, kind):
            if k == DATA:
                view = View(now, what[0], what[1], what[2], what[3], self.position, self.params, self.memory)
                for side, want in zip("BS", self.decide(view), strict=True):
                    self._want(now, side, want)
            elif k == ORDER:
                act, ref, side, price = what
                if act == "cancel":
                    self.exchange.cancel(ref)
                else:
                    self._filled(now, self.exchange.submit(ref, side, price, self.shares))
            elif k == REPORT and what[0] not in self.exchange.mine:
                for side, w in self.working.items():
                    if w and w[0] == what[0]:
                        self.working[side] = None

    def _want(self, now: int, side: str, price: int | None) -> None:
        have = self.working[side]
        if have and price == have[1]:
            return
        if have:
            self.queue.put(now + self.delays[1], ORDER, ("cancel", have[0], side, None))
            self.working[side] = None
        if price is None:
            return
        if self.token_at is not None:
            self.tokens = min(self.limits.rate, self.tokens + (now - self.token_at) * 1e-6 * self.limits.rate)
        self.token_at = now
        signed = self.shares if side == "B" else -self.shares
        if self.limits.refusal(signed, price, self.mid, self.position, self.tokens, self.killed):
            self.refused += 1
            return
        self.tokens -= 1
        self.orders += 1
        ref = next(self.refs)
        self.memory[("side", ref)] = side
        self.working[side] = (ref, price)
        self.queue.put(now + self.delays[1], ORDER, ("new", ref, side, price))


RESULT = "run long, symbol long, strategy string, orders long, refused long, fills long, position long, total long, diverted long, through long, minutes array<long>"


def axes(**values: list) -> list[dict]:
    """Every combination of parameter values, at most 1024."""
    made = [dict(zip(values, combo, strict=True)) for combo in itertools.product(*values.values())]
    if len(made) > 1024:
        raise ValueError("a sweep has at most 1024 parameter sets")
    return made


def sweep(messages: DataFrame, runs: list[tuple[str, dict]]) -> DataFrame:
    """Every run over every symbol: one row each, with its profit by minute.

    The runs (bounded, see axes) multiply the messages by key only; each (run, symbol) is a task's
    sorted stream and is never held as a whole.
    """
    ensure_importable(messages.sparkSession)
    names = ["symbol", "seq", "ts_us", "msg_type", "ref", "new_ref", "side", "shares", "price"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, test, rows = None, None, []

        def close() -> None:
            if test is not None:
                test.finish()
                c = test.exchange.counts
                rows.append((*now, runs[now[0]][0], test.orders, test.refused, len(test.fills), test.position, test.total(), c["diverted"], c["through"], list(test.minutes.values())))

        for batch in batches:
            for m in batch.to_pylist():
                if (m["run"], m["symbol"]) != now:
                    close()
                    now = (m["run"], m["symbol"])
                    test = Backtest(runs[now[0]][0], runs[now[0]][1])
                test.message(m)
        close()
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split(" ")[0] for f in RESULT.split(", ")])

    each = messages.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(runs) - 1).cast("long"))).alias("run"), *names)
    return each.repartition("run", "symbol").sortWithinPartitions("run", "symbol", "seq").mapInArrow(run, RESULT)


def match_orders(orders: DataFrame, stp: str = "none") -> DataFrame:
    """Runs (symbol, seq, ref, owner, side, shares, price, ioc, post_only) through matching engines, one a symbol."""
    ensure_importable(orders.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, engine = None, None
        for batch in batches:
            rows = []
            for o in batch.to_pylist():
                if o["symbol"] != now:
                    now, engine = o["symbol"], Matching(stp)
                rows += [(now, o["seq"], k, *e) for k, e in enumerate(engine.submit(o["ref"], o["owner"], o["side"], o["shares"], o["price"], ioc=o["ioc"], post_only=o["post_only"]))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["symbol", "seq", "part", "kind", "ref", "other", "shares", "price"])

    return orders.repartition("symbol").sortWithinPartitions("symbol", "seq").mapInArrow(run, "symbol long, seq long, part long, kind string, ref long, other long, shares long, price long")
