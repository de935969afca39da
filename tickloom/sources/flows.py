"""Synthetic order flows, reproducible by seed and symbol whatever the partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.session import ensure_importable

MESSAGES = "symbol long, seq long, ts_us long, msg_type string, ref long, new_ref long, side string, shares long, price long"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
#: Multipliers and key steps of the counter-based generator Philox 4x32.
PHILOX_M = (0xD2511F53, 0xCD9E8D57)
PHILOX_W = (0x9E3779B9, 0xBB67AE85)


def philox(counter: np.ndarray, key: tuple[int, int], rounds: int = 10) -> np.ndarray:
    """Random words of counters, rows of four 32-bit words each: any order, any machine, same numbers."""
    c = [counter[:, i].astype(np.uint64) for i in range(4)]
    k0, k1 = key
    low = np.uint64(0xFFFFFFFF)
    for _ in range(rounds):
        a, b = c[0] * np.uint64(PHILOX_M[0]), c[2] * np.uint64(PHILOX_M[1])
        c = [(b >> np.uint64(32)) ^ c[1] ^ np.uint64(k0), b & low, (a >> np.uint64(32)) ^ c[3] ^ np.uint64(k1), a & low]
        k0, k1 = (k0 + PHILOX_W[0]) & 0xFFFFFFFF, (k1 + PHILOX_W[1]) & 0xFFFFFFFF
    return np.stack(c, axis=1).astype(np.uint32)


class Draws:
    """Uniform numbers in [0, 1) by (seed, symbol), one after another."""

    def __init__(self, seed: int, symbol: int) -> None:
        self.key, self.at, self.held = (seed & 0xFFFFFFFF, symbol & 0xFFFFFFFF), 0, []

    def uniform(self) -> float:
        if not self.held:
            n = 1024
            counter = np.zeros((n, 4), np.uint32)
            counter[:, 0] = np.arange(self.at, self.at + n)
            self.at += n
            self.held = (philox(counter, self.key).ravel() / 2**32).tolist()[::-1]
        return self.held.pop()

    def below(self, n: int) -> int:
        return int(self.uniform() * n)


def random_legal(seed: int, symbol: int, n: int) -> Iterator[tuple]:
    """Adds near a drifting mid, and executions, cancels, deletes and replaces of orders that live."""
    d, live, mid, ts, next_ref = Draws(seed, symbol), [], 100_000, 0, symbol * 10_000_000 + 1
    for seq in range(n):
        ts += 1 + d.below(2_000_000)
        if d.below(50) == 0:
            mid += 100 * (d.below(3) - 1)
        act = d.below(10) if live else 0
        if act < 5 or len(live) < 4:
            side = "BS"[d.below(2)]
            price = mid + (-100 if side == "B" else 100) * (1 + d.below(8))
            shares = 100 * (1 + d.below(10))
            live.append([next_ref, side, shares, price])
            yield symbol, seq, ts, "A", next_ref, None, side, shares, price
            next_ref += 1
            continue
        k = d.below(len(live))
        ref, side, left, price = live[k]
        if act == 5 and left > 1:
            cut = 1 + d.below(left - 1)
            live[k][2] -= cut
            yield symbol, seq, ts, "X", ref, None, None, cut, None
        elif act in (6, 7):
            cut = 1 + d.below(left)
            live[k][2] -= cut
            if not live[k][2]:
                live.pop(k)
            yield symbol, seq, ts, "E", ref, None, None, cut, None
        elif act == 8:
            live.pop(k)
            shares, price = 100 * (1 + d.below(10)), price + 100 * (d.below(3) - 1)
            live.append([next_ref, side, shares, price])
            yield symbol, seq, ts, "U", ref, next_ref, None, shares, price
            next_ref += 1
        else:
            live.pop(k)
            yield symbol, seq, ts, "D", ref, None, None, None, None


def queue_reactive(seed: int, symbol: int, n: int, levels: int = 3, theta: float = 0.6) -> Iterator[tuple]:
    """Limit, cancel and market orders whose rates depend on the queues; an empty best moves the mid with probability theta."""
    d, mid, ts, next_ref = Draws(seed, symbol), 100_050, 0, symbol * 10_000_000 + 1
    queues: dict[tuple[str, int], list[int]] = {}
    for seq in range(n):
        rates, acts = [], []
        for s, sign in (("B", -1), ("S", 1)):
            for i in range(levels):
                at = (s, mid + sign * (50 + 100 * i))
                size = len(queues.get(at, []))
                rates += [2 / (1 + i), 0.3 * size, 0.8 if size and not any(queues.get((s, mid + sign * (50 + 100 * j))) for j in range(i)) else 0.0]
                acts += [("L", at), ("C", at), ("M", at)]
        total = sum(rates)
        ts += int(1 - np.log(1 - d.uniform()) / total * 1e6)
        pick, k = d.uniform() * total, 0
        while pick >= rates[k] and k < len(rates) - 1:
            pick -= rates[k]
            k += 1
        kind, at = acts[k]
        if kind == "L":
            queues.setdefault(at, []).append(next_ref)
            yield symbol, seq, ts, "A", next_ref, None, at[0], 100, at[1]
            next_ref += 1
            continue
        q = queues[at]
        ref = q.pop(0 if kind == "M" else d.below(len(q)))
        yield (symbol, seq, ts, "E", ref, None, None, 100, None) if kind == "M" else (symbol, seq, ts, "D", ref, None, None, None, None)
        best = mid + (-50 if at[0] == "B" else 50)
        if not q and at[1] == best and d.uniform() < theta:
            mid += -100 if at[0] == "B" else 100


MODELS = {"random": random_legal, "queue_reactive": queue_reactive}


def generate(spark: SparkSession, model: str, seed: int, symbols: int, n: int) -> DataFrame:
    """n messages of each symbol, a partition to some symbols."""
    ensure_importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbol in batch.column("id").to_pylist():
                rows = list(MODELS[model](seed, symbol, n))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], names=[c.split(" ")[0] for c in MESSAGES.split(", ")])

    return spark.range(symbols).mapInArrow(run, MESSAGES)
