"""Prediction-market execution: orders, ledger, risk, a simulated venue, a maker and arbitrage plans.

Amounts are integers: prices in 1e-4 USD, sizes in 1e-6 shares, money in 1e-10 USD. Each class is a
state machine fed in order; ``replay`` runs them over recorded quotes, a task per token group.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import ensure_importable

FULL = 10_000
STATES = ("new", "sent", "live", "partial", "filled", "cancelling", "cancelled", "rejected", "unknown")
FINAL = {"filled", "cancelled", "rejected"}


def taker_fee(size: int, price: int, rate_ppm: int, exponent: int = 1) -> int:
    """Half up to 1e-5 USD, in 1e-10 USD."""
    top, bottom = size * rate_ppm * (price * (FULL - price)) ** exponent * 10**5, 10**12 * 10 ** (8 * exponent)
    return (2 * top + bottom) // (2 * bottom) * 10**5


@dataclass
class Order:
    ref: int
    token: int
    buy: bool
    price: int
    size: int
    state: str = "sent"
    filled: int = 0
    seen: set = field(default_factory=set)
    sent_at: int = 0


class Oms:
    """Order states from reports that may repeat, come late or out of order. A fill id counts once, in any state."""

    def __init__(self) -> None:
        self.orders: dict[int, Order] = {}
        self.early: dict[int, list[tuple]] = defaultdict(list)
        self.unheard: deque[int] = deque()  # in order of sending
        self.odd = 0

    def submit(self, o: Order) -> None:
        self.orders[o.ref] = o
        self.unheard.append(o.ref)
        for report in self.early.pop(o.ref, []):
            self.on_report(o.ref, *report)

    def cancel(self, ref: int) -> bool:
        o = self.orders.get(ref)
        if o is None or o.state in FINAL or o.state == "cancelling":
            return False
        o.state = "cancelling"
        return True

    def cancel_all(self) -> list[int]:
        """References of the orders that a cancel has now to be sent for."""
        return [ref for ref in self.orders if self.cancel(ref)]

    def on_timer(self, now: int, patience_us: int) -> list[int]:
        """Orders that nothing was heard of for too long become unknown; their references."""
        late = []
        while self.unheard and ((o := self.orders[self.unheard[0]]).state != "sent" or now - o.sent_at > patience_us):
            if o.state == "sent":
                self.on_report(o.ref, "timeout")
                late.append(o.ref)
            self.unheard.popleft()
        return late

    def on_report(self, ref: int, kind: str, fill_id: int | None = None, size: int = 0) -> int:
        """Applies ack, reject, fill, cancelled or timeout; the shares that are new."""
        o = self.orders.get(ref)
        if o is None:
            self.early[ref].append((kind, fill_id, size))
            return 0
        if kind == "fill":
            if fill_id in o.seen:
                return 0
            o.seen.add(fill_id)
            size = min(size, o.size - o.filled)
            o.filled += size
            if o.filled == o.size:
                o.state = "filled"
            elif o.state not in ("cancelling", "cancelled"):
                o.state = "partial"
            return size
        if o.state in FINAL:
            self.odd += kind not in ("ack", "cancelled")
        elif kind == "ack" and o.state in ("sent", "unknown"):
            o.state = "partial" if o.filled else "live"
        elif kind == "reject":
            o.state = "rejected"
        elif kind == "cancelled":
            o.state = "cancelled"
        elif kind == "timeout" and o.state == "sent":
            o.state = "unknown"
        return 0


class Ledger:
    """Cash, positions with proportional cost, realised profit. A trade may fail to settle and is then reversed.

    A settlement that comes before its fill is an orphan until the fill is there.
    """

    def __init__(self) -> None:
        self.cash = self.fees = self.realised = 0
        self.position: Counter = Counter()
        self.cost: Counter = Counter()
        self.pending: dict[int, tuple] = {}
        self.orphans: dict[int, bool] = {}  # fill -> whether it settled
        self.done: set[int] = set()

    def fill(self, fill_id: int, token: int, signed: int, price: int, fee: int) -> None:
        had = self.position[token]
        self.cash -= signed * price + fee
        self.fees += fee
        before = (self.cost[token], self.realised)
        if signed > 0:
            self.cost[token] += signed * price
        else:
            part = self.cost[token] * -signed // had if had > 0 else 0
            self.cost[token] -= part
            self.realised += -signed * price - part
        self.position[token] += signed
        self.pending[fill_id] = (token, signed, price, fee, self.cost[token] - before[0], self.realised - before[1])
        if fill_id in self.orphans:
            self.settle(fill_id, self.orphans.pop(fill_id))

    def settle(self, fill_id: int, good: bool) -> bool:
        """A settlement report, or that a trade failed to settle; a repeated one changes nothing."""
        if fill_id in self.done:
            return False
        if fill_id not in self.pending:
            self.orphans[fill_id] = good
            return False
        self.done.add(fill_id)
        return self.settled(fill_id) if good else self.failed(fill_id)

    def settled(self, fill_id: int) -> bool:
        return self.pending.pop(fill_id, None) is not None

    def failed(self, fill_id: int) -> bool:
        t = self.pending.pop(fill_id, None)
        if t is None:
            return False
        token, signed, price, fee, cost, gain = t
        self.cash += signed * price + fee
        self.fees -= fee
        self.position[token] -= signed
        self.cost[token] -= cost
        self.realised -= gain
        return True

    def merge(self, tokens: list[int], size: int) -> None:
        """A full set of a group's tokens becomes cash."""
        for t in tokens:
            part = self.cost[t] * size // self.position[t] if self.position[t] else 0
            self.cost[t] -= part
            self.position[t] -= size
            self.realised -= part
        self.cash += size * FULL
        self.realised += size * FULL

    def split(self, tokens: list[int], size: int) -> None:
        """Cash becomes a full set; its cost is shared evenly, the rest of the division on the first token."""
        total = size * FULL
        for i, t in enumerate(tokens):
            self.cost[t] += total // len(tokens) + (total % len(tokens) if i == 0 else 0)
            self.position[t] += size
        self.cash -= total

    def resolve(self, winner: int, tokens: list[int]) -> None:
        for t in tokens:
            pay = self.position[t] * FULL if t == winner else 0
            self.cash += pay
            self.realised += pay - self.cost[t]
            self.position[t] = self.cost[t] = 0

    def balanced(self) -> bool:
        """Cash spent is what positions cost, less what was realised, plus fees."""
        return self.cash == self.realised - self.fees - sum(self.cost.values())


@dataclass
class Risk:
    """Checks in a fixed order; the first that fails names the refusal."""

    max_order: int = 10**9
    max_position: int = 10**10
    max_gross: int = 10**14
    max_open: int = 50
    max_loss: int = 10**13
    collar: int = 2000
    per_second: float = 20.0
    burst: float = 40.0
    killed: bool = False
    daily_stop: int = 10**14  # loss at the worse of mid and bid, in 1e-10 USD
    reject_spike: int = 20  # venue rejects within the window that trading stops after
    reject_window: float = 10.0
    why: str | None = None
    reasons: Counter = field(default_factory=Counter)
    tokens: float = 40.0
    at: float | None = None
    rejects: deque = field(default_factory=deque)

    def kill(self, why: str) -> None:
        """Stops trading for good; the first reason stands."""
        if not self.killed:
            self.killed, self.why = True, why

    def on_tick(self, at_mid: int, at_bid: int) -> None:
        if min(at_mid, at_bid) < -self.daily_stop:
            self.kill("loss")

    def on_reject(self, now: float) -> None:
        self.rejects.append(now)
        while self.rejects[0] <= now - self.reject_window:
            self.rejects.popleft()
        if len(self.rejects) > self.reject_spike:
            self.kill("rejects")

    def check(self, now: float, buy: bool, price: int, size: int, *, position: int, gross: int, open_orders: int, total: int, mid: int | None, fresh: bool = True, tick: int = 1, least: int = 1, resolved: bool = False) -> str | None:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + (now - self.at) * self.per_second)
        self.at = now
        tests = (
            ("killed", self.killed), ("resolved", resolved), ("stale", not fresh), ("price", not 0 < price < FULL), ("tick", price % tick != 0), ("minimum", size < least), ("order_size", size > self.max_order),
            ("position", abs(position + (size if buy else -size)) > self.max_position), ("short", not buy and size > position), ("gross", gross + size * price > self.max_gross), ("open_orders", open_orders >= self.max_open),
            ("loss", total < -self.max_loss), ("collar", mid is not None and abs(price - mid) > self.collar), ("rate", self.tokens < 1),
        )
        why = next((name for name, hit in tests if hit), None)
        if why:
            self.reasons[why] += 1
        else:
            self.tokens -= 1
        return why


class Venue:
    """Answers requests after a latency against the latest quotes; fills of resting orders wait for what is ahead.

    faults: every how many reports one is repeated (repeat) or late (delay), every how many requests one is
    refused (refuse) or lost (lose), and every how many trades one fails to settle (fail).
    """

    def __init__(self, latency_us: int = 100_000, settle_us: int = 2_000_000, faults: dict[str, int] | None = None) -> None:
        self.latency, self.settle, self.faults = latency_us, settle_us, faults or {}
        self.quotes: dict[int, tuple] = {}
        self.resting: dict[int, list] = {}
        self.heap: list[tuple] = []
        self.n = self.requests = self.trades = 0
        self.position: Counter = Counter()  # by token, of trades that did not fail

    def _due(self, name: str, count: int) -> bool:
        return bool(self.faults.get(name)) and count % self.faults[name] == 0

    def _put(self, at: int, what: tuple) -> None:
        heapq.heappush(self.heap, (at, self.n, what))
        self.n += 1

    def request(self, now: int, o: Order) -> None:
        self._put(now + self.latency, ("arrive", o))

    def cancel(self, now: int, ref: int) -> None:
        self._put(now + self.latency, ("cancel", ref))

    def _report(self, at: int, ref: int, kind: str, *rest) -> Iterator[tuple]:
        self.n += 1
        if self._due("delay", self.n - 1):
            self._put(at + 10 * self.latency, ("tell", ref, kind, *rest))
        else:
            yield at, ref, kind, *rest
        if self._due("repeat", self.n - 1):
            self._put(at + self.latency, ("tell", ref, kind, *rest))

    def run(self, now: int) -> Iterator[tuple]:
        """Reports due: (time, ref, kind, fill_id, size, price, maker); settlements have a fill_id only."""
        while self.heap and self.heap[0][0] <= now:
            at, _, what = heapq.heappop(self.heap)
            if what[0] == "tell":
                yield at, *what[1:]
            elif what[0] == "cancel":
                yield from self._report(at, what[1], "cancelled" if self.resting.pop(what[1], None) else "ack")
            else:
                yield from self._arrive(at, what[1])

    def _trade(self, at: int, o: Order, size: int, price: int, maker: bool) -> Iterator[tuple]:
        self.trades += 1
        failed, fill_id = self._due("fail", self.trades), self.n
        if not failed:
            self.position[o.token] += size if o.buy else -size
        yield from self._report(at, o.ref, "fill", fill_id, size, price, maker)
        self._put(at + self.settle, ("tell", o.ref, "failed" if failed else "settled", fill_id))

    def _arrive(self, at: int, o: Order) -> Iterator[tuple]:
        self.requests += 1
        if self._due("lose", self.requests):
            return
        q = self.quotes.get(o.token)
        if q is None or self._due("refuse", self.requests):
            yield from self._report(at, o.ref, "reject")
            return
        yield from self._report(at, o.ref, "ack")
        price, size = (q[2], q[3]) if o.buy else (q[0], q[1])
        n = min(o.size, size) if price is not None and (price <= o.price if o.buy else price >= o.price) else 0
        if n:
            self.quotes[o.token] = (q[0], q[1], q[2], q[3] - n) if o.buy else (q[0], q[1] - n, q[2], q[3])
            yield from self._trade(at, o, n, price, False)
        if n < o.size:
            ahead = (q[1] if o.price == q[0] else 0) if o.buy else (q[3] if o.price == q[2] else 0)
            self.resting[o.ref] = [o, o.size - n, ahead]

    def on_trade(self, now: int, token: int, price: int, size: int) -> Iterator[tuple]:
        for ref, rest in list(self.resting.items()):
            o = rest[0]
            if o.token != token or (price > o.price if o.buy else price < o.price):
                continue
            through = price < o.price if o.buy else price > o.price
            eaten = 0 if through else min(size, rest[2])
            rest[2] -= eaten
            n = min(rest[1], size - eaten)
            if n:
                rest[1] -= n
                if not rest[1]:
                    del self.resting[ref]
                yield from self._trade(now, o, n, o.price, True)


@dataclass
class Maker:
    """What a quoter is set by; ``fee_ppm`` and the stops belong to the session around it."""

    gamma: float = 0.1
    k: float = 30.0
    horizon_s: float = 3600.0
    size: int = 10_000_000
    most: float = 5.0  # inventory in sizes; the side that would pass it is not quoted
    low: float = 0.05  # mids outside low and high are not quoted
    high: float = 0.95
    warm_s: float = 30.0
    memory_s: float = 60.0
    prior: float = 1e-4
    tick: int = 10
    fee_ppm: int = 0
    daily_stop: int = 10**14
    max_gross: int = 10**14

    def __post_init__(self) -> None:
        bad = [n for n in ("gamma", "k", "horizon_s", "size", "memory_s", "tick") if getattr(self, n) <= 0]
        if bad or not 0 < self.low < self.high < 1:
            raise ValueError(f"a maker needs positive {bad}" if bad else "a maker needs 0 < low < high < 1")


@dataclass
class QuoteView:
    bid: int
    ask: int
    mid: float  # as a probability
    inventory: float  # in sizes, signed
    variance: float  # of log-odds a second
    maker: Maker


#: Quoters by name: from a view to (bid, ask) in 1e-4 USD before they are kept off the touch.
QUOTERS: dict[str, Callable[[QuoteView], tuple[float, float]]] = {}


def quoter(name: str):
    """Registers a quoter; names are taken once."""

    def put(f):
        if name in QUOTERS:
            raise ValueError(f"there is a quoter {name}")
        QUOTERS[name] = f
        return f

    return put


@quoter("logit")
def _logit(v: QuoteView) -> tuple[float, float]:
    """Quotes around a mid that inventory and variance shift, in log-odds."""
    m = v.maker
    risk = m.gamma * v.variance * m.horizon_s
    centre = math.log(v.mid / (1 - v.mid)) - v.inventory * risk
    half = risk / 2 + math.log1p(m.gamma / m.k) / m.gamma
    chance = lambda y: FULL / (1 + math.exp(-y)) if y > -700 else 0.0
    return chance(centre - half), chance(centre + half)


@quoter("skew")
def _skew(v: QuoteView) -> tuple[float, float]:
    """Two ticks about the mid, one tick lower for each size held."""
    centre = v.mid * FULL - round(v.inventory) * v.maker.tick
    return centre - 2 * v.maker.tick, centre + 2 * v.maker.tick


def maker_quote(name: str, v: QuoteView) -> tuple[int | None, int | None]:
    """A quoter's prices on the grid, never through the touch, outside (0, 1) or on a side that holds too much."""
    m = v.maker
    if not m.low <= v.mid <= m.high:
        return None, None
    bid, ask = QUOTERS[name](v)
    b, a = min(int(bid // m.tick * m.tick), v.ask - m.tick), max(int(-(-ask // m.tick) * m.tick), v.bid + m.tick)
    return b if 0 < b < FULL and v.inventory < m.most else None, a if 0 < a < FULL and v.inventory > -m.most else None


def arb_plan(asks: list[int], sizes: list[int], cash: int, fee_rates: list[int], least_edge: int = 1, most: int = 10**12) -> tuple[int, int] | None:
    """Buying one of each leg: (size, net profit in 1e-10 USD) if it pays after fees, by the thinnest leg and the cash."""
    if not asks or any(a is None for a in asks):
        return None
    edge = FULL - sum(asks)
    if edge < least_edge:
        return None
    size = min(*sizes, most, cash // max(1, sum(asks))) if len(sizes) > 1 else min(sizes[0], most, cash // max(1, asks[0]))
    if size <= 0:
        return None
    net = size * edge - sum(taker_fee(size, a, r) for a, r in zip(asks, fee_rates, strict=True))
    return (size, net) if net > 0 else None


def walk(levels: list[tuple[int, int]], size: int) -> tuple[int, int]:
    """Taking a size from levels, best first: (shares got, money paid)."""
    got = paid = 0
    for price, there in levels:
        n = min(size - got, there)
        got, paid = got + n, paid + n * price
        if got == size:
            break
    return got, paid


def choose(held: list[int], asks: list[int], bids: list[int], cash: int) -> tuple[str, int]:
    """With legs unevenly held: complete the set, unwind what is over, or keep it, by what is worth more. (action, value)"""
    full, least = max(held), min(held)
    missing = [full - h for h in held]
    cost = sum(m * a for m, a in zip(missing, asks, strict=True))
    complete = full * FULL - cost if cost <= cash else -(1 << 62)
    unwind = least * FULL + sum((h - least) * b for h, b in zip(held, bids, strict=True))
    return ("complete", complete) if complete >= unwind else ("unwind", unwind)


class Session:
    """A maker over a group's tokens: quotes in, requests through risk to the venue, reports to the books.

    Variance is of log-odds, decayed by clock time. When the kill switch trips every open order is
    cancelled, once, and nothing is sent after. Positions that still differ from the venue's when
    everything has settled trip it too.
    """

    def __init__(self, quoter: str = "logit", maker: Maker | None = None, faults: dict[str, int] | None = None) -> None:
        self.maker, self.quoter = maker or Maker(), quoter
        self.oms, self.ledger, self.venue = Oms(), Ledger(), Venue(faults=faults)
        self.risk = Risk(daily_stop=self.maker.daily_stop, max_gross=self.maker.max_gross)
        self.next = 1
        self.quotes: dict[int, tuple[int, int]] = {}
        self.odds: dict[int, tuple[int, float]] = {}
        self.begun: dict[int, int] = {}
        self.variance: dict[int, float] = {}
        self.working: dict[tuple[int, bool], Order] = {}
        self.maker_fills = self.taker_fills = self.digest = 0
        self.halted = False

    def total(self, at_bid: bool = False) -> int:
        """Cash and positions, at the mids or at what closing them would get."""
        value = 0
        for token, held in self.ledger.position.items():
            bid, ask = self.quotes.get(token, (0, 0))
            value += held * (bid if held > 0 else ask) if at_bid else held * (bid + ask) // 2
        return self.ledger.cash + value

    def quote(self, now: int, token: int, bid: int, bid_size: int, ask: int, ask_size: int) -> None:
        m = self.maker
        self._reports(self.venue.run(now))
        self.oms.on_timer(now, 20 * self.venue.latency)
        self.venue.quotes[token] = (bid, bid_size, ask, ask_size)
        self.quotes[token] = (bid, ask)
        mid = min(max((bid + ask) / 2 / FULL, 1e-4), 1 - 1e-4)
        x = math.log(mid / (1 - mid))
        then, was = self.odds.get(token, (now, x))
        dt = (now - then) * 1e-6
        if dt > 0:
            fade = math.exp(-dt / m.memory_s)
            self.variance[token] = fade * self.variance.get(token, m.prior) + (1 - fade) * (x - was) ** 2 / dt
        self.odds[token] = (now, x)
        self.begun.setdefault(token, now)
        self.risk.on_tick(self.total(), self.total(at_bid=True))
        self._halt(now)
        warm = (now - self.begun[token]) * 1e-6 >= m.warm_s
        view = QuoteView(bid, ask, mid, self.ledger.position[token] / m.size, self.variance.get(token, m.prior), m)
        wants = maker_quote(self.quoter, view) if warm and not self.halted else (None, None)
        for buy, price in zip((True, False), wants, strict=True):
            have = self.working.get((token, buy))
            if have and have.state not in FINAL:
                if have.price == price:
                    continue
                if self.oms.cancel(have.ref):
                    self.venue.cancel(now, have.ref)
            if price is None:
                continue
            live = [o for o in self.working.values() if o.state not in FINAL]
            why = self.risk.check(now * 1e-6, buy, price, m.size, position=self.ledger.position[token], gross=sum(o.size * o.price for o in live), open_orders=len(live), total=self.ledger.realised - self.ledger.fees, mid=(bid + ask) // 2)
            self.digest = (self.digest * 1_000_003 + token * 31 + price * 2 + buy + len(why or "")) % (1 << 61)
            if why:
                continue
            o = Order(self.next, token, buy, price, m.size, sent_at=now)
            self.next += 1
            self.working[(token, buy)] = o
            self.oms.submit(o)
            self.venue.request(now, o)

    def trade(self, now: int, token: int, price: int, size: int) -> None:
        self._reports(self.venue.run(now))
        self._reports(self.venue.on_trade(now, token, price, size))

    def finish(self) -> None:
        """Takes every report that is under way, then compares positions with the venue's."""
        self._reports(self.venue.run(1 << 62))
        if any(self.ledger.position[t] != self.venue.position[t] for t in self.ledger.position | self.venue.position):
            self.risk.kill("mismatch")

    def _halt(self, now: int) -> None:
        if self.risk.killed and not self.halted:
            self.halted = True
            for ref in self.oms.cancel_all():
                self.venue.cancel(now, ref)

    def _reports(self, reports) -> None:
        for at, ref, kind, *rest in reports:
            fill_id, size, price, maker = (rest + [None] * 4)[:4]
            if kind in ("settled", "failed"):
                self.ledger.settle(fill_id, kind == "settled")
                continue
            if kind == "reject":
                self.risk.on_reject(at * 1e-6)
            n = self.oms.on_report(ref, kind, fill_id, size or 0)
            if n:
                o = self.oms.orders[ref]
                self.maker_fills += maker
                self.taker_fills += not maker
                self.ledger.fill(fill_id, o.token, n if o.buy else -n, price, 0 if maker else taker_fee(n, price, self.maker.fee_ppm))


RESULT = "run long, grp long, quoter string, orders long, maker_fills long, taker_fills long, refused long, realised long, fees long, cash long, total long, kill string, balanced boolean, odd long, digest long"


def variants(quoters: list[str] = ("logit",), **values: list) -> list[tuple[str, dict]]:
    """Every combination of quoters and a maker's values, checked here; at most 256."""
    made = [(q, dict(zip(values, c, strict=True))) for q in quoters for c in itertools.product(*values.values())]
    if len(made) > 256:
        raise ValueError(f"a sweep has {len(made)} runs; at most 256")
    for q, v in made:
        if q not in QUOTERS:
            raise ValueError(f"unknown quoter {q}")
        Maker(**v)
    return made


def replay(quotes: DataFrame, faults: dict[str, int] | None = None, runs: list[tuple[str, dict]] | None = None) -> DataFrame:
    """A maker session for each run over each group's recorded quotes (grp, token, seq, ts_us, bid, ask, bid_size, ask_size).

    Runs (bounded, see variants) multiply the quotes by key only; each (run, group) is a task's sorted
    stream and is never held as a whole.
    """
    ensure_importable(quotes.sparkSession)
    runs = runs or [("logit", {})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, rows = None, None, []

        def close() -> None:
            if s is not None:
                s.finish()
                rows.append((*now, s.quoter, len(s.oms.orders), s.maker_fills, s.taker_fills, sum(s.risk.reasons.values()), s.ledger.realised, s.ledger.fees, s.ledger.cash, s.total(), s.risk.why, s.ledger.balanced(), s.oms.odd, s.digest))

        for batch in batches:
            for q in batch.to_pylist():
                if (q["run"], q["grp"]) != now:
                    close()
                    now = (q["run"], q["grp"])
                    s = Session(runs[now[0]][0], Maker(**runs[now[0]][1]), faults)
                s.quote(q["ts_us"], q["token"], q["bid"], q["bid_size"] * 1_000_000, q["ask"], q["ask_size"] * 1_000_000)
                if q["seq"] % 3 == 0:
                    s.trade(q["ts_us"], q["token"], q["bid"] if q["seq"] % 2 else q["ask"], q["bid_size"] * 1_000_000)
        close()
        fields = [f.split(" ") for f in RESULT.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    each = quotes.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(runs) - 1).cast("long"))).alias("run"), "grp", "token", "seq", "ts_us", "bid", "ask", "bid_size", "ask_size")
    return each.repartition("run", "grp").sortWithinPartitions("run", "grp", "seq").mapInArrow(run, RESULT)
