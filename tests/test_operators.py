"""Hand-computed cases of the operators, most from small tapes written here."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import market as fm
from tickloom.functions import models, settings
from tickloom.operators import book, kernels, micro, pm, pm_exec, sim, stats, studies, surveil
from tickloom.operators.asof import asof
from tickloom.sources import flows, itch, recordings, runs

QUOTE = "symbol long, seq long, ts_us long, bid_px long, bid_qty long, ask_px long, ask_qty long"
MESSAGE = "symbol long, seq long, ts_us long, msg_type string, ref long, new_ref long, side string, shares long, price long"


def col(df, c):
    return [r[c] for r in df.collect()]


def test_ofi_of_seven_next_quotes(spark):
    following = [(100, 700, 101, 400), (100, 500, 101, 100), (100, 700, 101, 150), (99, 900, 101, 400), (100, 500, 101, 400), (101, 400, 102, 300), (100, 500, 101, 430)]
    want = [200, 300, 450, -500, 0, 800, -30]
    rows = [r for k, q in enumerate(following) for r in ((k, 0, 0, 100, 500, 101, 400), (k, 1, 1, *q))]
    got = micro.ofi_events(spark.createDataFrame(rows, QUOTE)).where("seq = 1").orderBy("symbol")
    assert col(got, "ofi") == want


def test_an_invalid_quote_breaks_the_chain(spark):
    rows = [(1, 0, 0, 100, 5, 101, 5), (1, 1, 1, 101, 5, 101, 5), (1, 2, 2, 100, 9, 101, 5)]
    assert col(micro.ofi_events(spark.createDataFrame(rows, QUOTE)).orderBy("seq"), "ofi") == [None, None, None]


def test_regression_of_a_line(spark):
    df = spark.createDataFrame([(1, float(x), 3 + 2.0 * x) for x in range(50)] + [(2, 1.0, 1.0)], "g long, x double, y double")
    got = {r["g"]: (r["slope"], r["intercept"], r["r2"]) for r in micro.regression(df, "y", "x", ["g"]).collect()}
    assert got == {1: (2.0, 3.0, 1.0), 2: (0.0, 0.0, 0.0)}


def test_micro_price_is_antisymmetric(spark):
    hi, mid, lo = 9, 4, 0
    rows = [(hi, mid, 2, 100), (9 - hi, 9 - mid, -2, 100), (mid, hi, 0, 50), (9 - mid, 9 - hi, 0, 50), (mid, lo, 0, 50), (9 - mid, 9 - lo, 0, 50)]
    g = micro.micro_price(spark.createDataFrame(rows, "from long, to long, d2 long, n long"), 1)
    assert g[9] == pytest.approx(1) and g[0] == pytest.approx(-1) and g[4] == pytest.approx(-g[5])


def test_lead_lag_counts(spark):
    lead = [(1, k, t, u) for k, (t, u) in enumerate([(0, 1), (3_000_000, -1), (6_000_000, 1), (9_000_000, 1)])]
    follow = [(2, 10 + k, t, u) for k, (t, u) in enumerate([(0, -1), (400_000, 1), (3_900_000, -1), (5_000_000, 1), (8_500_000, 1)])]
    moves = spark.createDataFrame(lead + follow, "symbol long, seq long, ts_us long, up long")
    pairs = spark.createDataFrame([(1, 2)], "leader long, follower long")
    r = micro.lead_lag(moves, pairs, 1_000_000).first()
    assert (r["leads"], r["answered"], r["same"]) == (3, 2, 2)  # the last lead has no later answer; equal times don't count


def test_volume_buckets_split_trades(spark):
    rows = [(1, k, k, d, s, 100, 102) for k, (s, d) in enumerate([(150, 1), (50, -1), (300, 1), (100, -1), (30, 1)])]
    got = micro.volume_buckets(spark.createDataFrame(rows, "symbol long, seq long, ts_us long, dir long, shares long, bid_px long, ask_px long"), 200).orderBy("bucket")
    assert [x / 200 for x in col(got, "abs_net")] == [0.5, 1.0, 0.0]


def test_markouts_exclude_a_quote_at_the_horizon(spark):
    quotes = spark.createDataFrame([(1, 1, 0, 100, 1, 102, 1), (1, 2, 1000, 200, 1, 202, 1), (1, 3, 5000, 300, 1, 302, 1)], QUOTE)
    trades = spark.createDataFrame([(1, 1, 0, 1, 10, 102, False, 100, 102)], "symbol long, seq long, ts_us long, dir long, shares long, price long, hidden boolean, bid_px long, ask_px long")
    assert micro.marked_trades(trades, quotes, 1000).first()["later_mid2"] == 202
    assert micro.marked_trades(trades, quotes, 1001).first()["later_mid2"] == 402


def test_asof_against_brute_force(spark):
    r = random.Random(2)
    left = [(r.randrange(3), k, r.randrange(40)) for k in range(60)]
    right = [(r.randrange(3), k, r.randrange(40)) for k in range(60)]
    a, b = spark.createDataFrame(left, "g long, id long, t long"), spark.createDataFrame(right, "g long, seq long, u long")
    for forward in (False, True):
        for equal in (False, True):
            got = {x["id"]: x["m_seq"] for x in asof(a, b, on=["g"], left_time=F.col("t"), right_time=F.col("u"), values=["seq"], prefix="m_", forward=forward, allow_equal=equal).collect()}
            for g, i, t in left:
                if forward:
                    near = [(u, s) for h, s, u in right if h == g and (u > t or equal and u == t)]
                    assert got[i] == (min(near)[1] if near else None)
                else:
                    near = [(u, s) for h, s, u in right if h == g and (u < t or equal and u == t)]
                    assert got[i] == (max(near)[1] if near else None)


def flow(spark, n=1500, model="random"):
    return flows.generate(spark, model, 11, 2, n)


@pytest.mark.parametrize("model", ["random", "queue_reactive"])
def test_generated_flows_are_legal_and_books_agree(spark, model):
    m = flow(spark, model=model)
    swept = kernels.sweep(m)
    assert swept.where("not ok").count() == 0
    lives = book.order_lives(m)
    # orders that executions or cancels used up end without a delete; the relational book keeps them at zero
    deltas = book.level_deltas(m, lives)
    depth = {(r["symbol"], r["side"], r["price"]): r["qty"] for r in book.full_depth(deltas).collect()}
    for symbol in (0, 1):
        state = kernels.BookState()
        state.start()
        for r in m.where(f"symbol = {symbol}").orderBy("seq").collect():
            state.apply(r.asDict())
        for side in "BS":
            assert {p: q for (s, d, p), q in depth.items() if (s, d) == (symbol, side)} == state.sides[side].qty


def test_flows_do_not_depend_on_partitions(spark):
    a = flow(spark).repartition(5).orderBy("symbol", "seq").collect()
    assert a == flow(spark).coalesce(1).orderBy("symbol", "seq").collect()


def test_refused_acts_change_nothing():
    b = kernels.BookState()
    b.start()
    assert b.add(1, "B", 100, 10) and not b.add(1, "B", 5, 10) and not b.reduce(1, 0) and not b.reduce(1, 101) and not b.reduce(2, 1)
    assert b.replace(1, 2, 50, 9) and not b.erase(1) and b.sides["B"].best() == (9, 50)
    assert b.add(3, "S", 10, 12) and not b.replace(2, 3, 1, 8) and b.sides["B"].best() == (9, 50)


def test_rejected_messages_have_reasons(spark):
    rows = [(1, 0, 0, "A", 1, None, "B", 100, 10), (1, 1, 0, "E", 1, None, None, 0, None), (1, 2, 0, "E", 1, None, None, 60, None), (1, 3, 0, "X", 1, None, None, 60, None), (1, 4, 0, "D", 9, None, None, None, None)]
    m = spark.createDataFrame(rows, MESSAGE)
    got = {r["seq"]: r["reason"] for r in book.rejected(m, book.order_lives(m)).collect()}
    assert got == {1: "empty", 3: "too_many", 4: "unknown"}


def test_replace_chains_of_any_length(spark):
    rows = [(1, 0, 0, "A", 1, None, "S", 100, 10)] + [(1, k, k, "U", k, k + 1, None, 100, 10 + k) for k in range(1, 20)]
    m = spark.createDataFrame(rows, MESSAGE)
    assert set(col(book.roots(m), "root")) == {1}
    assert set(col(book.order_lives(m), "side")) == {"S"}


def test_frames_round_trip(spark, tmp_path):
    m = flow(spark, 300).where("symbol = 0").orderBy("seq").collect()
    data = b"".join(itch.encode(r.asDict() | {"ts_ns": r["ts_us"] % 86_400_000_000 * 1000, "locate": 1, "stock": "TEST"}) for r in m)
    bad = (3).to_bytes(2, "big") + b"?ab" + (5).to_bytes(2, "big") + b"Aabcd"
    (tmp_path / "day.bin").write_bytes(data + bad + b"\0")
    got = itch.read_days(spark, str(tmp_path))
    good, rejects = itch.split_rejects(got)
    assert sorted(col(rejects, "status")) == ["truncated", "unknown_type"]
    back = good.orderBy("seq").collect()
    assert [(r["msg_type"], r["ref"], r["shares"], r["price"]) for r in back] == [(r["msg_type"], r["ref"], r["shares"], r["price"]) for r in m]
    itch.ingest(got, str(tmp_path / "store"), "2024-01-02")
    scan = itch.symbol_scan(spark, str(tmp_path / "store"), "2024-01-02", "TEST")
    assert scan.count() == len(m)
    assert b"".join(r["frame"] for r in itch.as_frames(scan).orderBy("seq").collect()) == data


def test_spoofs(spark):
    def tape(executed, life_ms, shares):
        rows = [(1, 0, 0, "A", 1, None, "S", 5000, 101), (1, 1, 0, "A", 2, None, "B", 200, 100), (1, 2, 1000, "A", 3, None, "B", shares, 100)]
        rows += [(1, 3, 2000, "E", 1, None, None, 1000, None)] + ([(1, 4, 3000, "E", 3, None, None, 1, None)] if executed else []) + [(1, 5, 1000 + life_ms * 1000, "D", 3, None, None, None, None)]
        m = spark.createDataFrame(rows, MESSAGE)
        q = kernels.sweep(m).select("symbol", "seq", "ts_us", "bid_px", "bid_qty", "ask_px", "ask_qty")
        return col(surveil.spoofs(m, book.order_lives(m), q, 2_000_000, 5000, 10, 1000), "opposite")

    assert tape(False, 499, 10_000) == [1000]
    assert tape(True, 499, 10_000) == [] and tape(False, 3000, 10_000) == [] and tape(False, 499, 4000) == []


def test_layers(spark):
    def orders(mpid, prices):
        rows = [(1, mpid, "B", p, 2000, k * 1000, k, 500_000 + k, 0) for k, p in enumerate(prices)]
        return spark.createDataFrame(rows, "symbol long, mpid string, side string, price long, shares long, add_ts long, add_seq long, end_ts long, executed long")

    got = surveil.layers(orders("ABCD", [100, 99, 98, 97, 96]), 50_000, 2_000_000, 4, 3, 5000).first()
    assert (got["orders"], got["levels"], got["shares"]) == (5, 5, 10_000)
    assert surveil.layers(orders("ABCD", [100, 99, 100, 99]), 50_000, 2_000_000, 4, 3, 5000).count() == 0


def test_stuffing(spark):
    quiet = [(1, k, k * 1_000_000, "A", k, None, "B", 1, 1) for k in range(60)]
    burst = [(1, 100 + k, 60_000_000 + k * 50, "AD"[k % 2], 1000 + k, None, "B", 1, 1) for k in range(2000)]
    r = surveil.stuffing(spark.createDataFrame(quiet + burst, MESSAGE), 100_000, 1000, 50, 0.01, 0.4).collect()
    assert len(r) == 1 and r[0]["execs"] == 0 and 1999 <= r[0]["msgs"] <= 2001


def test_bursts_last_from_their_first_row(spark):
    df = spark.createDataFrame([(1, t, k) for k, t in enumerate([0, 30, 60, 90, 200])], "g long, t long, k long")
    assert col(kernels.bursts(df, ["g"], "t", "k", 50).orderBy("k"), "burst") == [0, 0, 1, 1, 2]


def test_features_look_only_back(spark):
    rows = [(1, k, k * 1000, 100 + k % 3, 10 + k, 103 + k % 2, 20, ("add", "cancel", "trade", "hidden")[k % 4], 1 - k % 2 * 2, 5 + k) for k in range(40)]
    schema = QUOTE + ", kind string, dir long, shares long"
    full = kernels.features(spark.createDataFrame(rows, schema)).where("seq < 20").orderBy("seq").collect()
    changed = rows[:20] + [(*r[:4], 999, *r[5:9], 77) for r in rows[20:]]
    assert kernels.features(spark.createDataFrame(changed, schema)).where("seq < 20").orderBy("seq").collect() == full


def test_hawkes_recovers_its_branching():
    r = np.random.default_rng(3)
    mu, branching, beta, horizon = 0.5, 0.5, 3.0, 2000.0
    t, alpha, now, a, times = 0.0, branching * beta, 0.0, 0.0, []
    while now < horizon:
        bound = mu + a
        step = r.exponential(1 / bound)
        now, a = now + step, a * math.exp(-beta * step)
        if now < horizon and r.random() * bound < mu + a:
            times.append(now)
            a += alpha
    m, al, be, _ = kernels.fit_hawkes(np.array(times), horizon)
    assert abs(al / be - branching) < 0.12 and abs(m - mu) < 0.15 and t == 0


def test_excitation_against_plain_sums():
    t = np.sort(np.random.default_rng(1).random(300) * 100)
    for beta in (0.01, 1.0, 50.0):
        a, b = kernels.excitation(t, beta)
        gap = t[:, None] - t[None, :]
        w = np.where(np.tri(300, k=-1) > 0, np.exp(-beta * np.maximum(gap, 0)), 0)
        assert np.allclose(a, w.sum(1)) and np.allclose(b, (gap * w).sum(1))
    crowd = np.sort(np.concatenate([k * 10 + np.arange(40) * 1e-3 for k in range(10)]))
    _, al, be, ll = kernels.fit_hawkes(crowd, 100.0)
    assert al < be and math.isfinite(ll) and math.isnan(kernels.fit_hawkes(crowd[:19], 100.0)[0])


def test_intensity_with_a_prior_on_every_bin():
    d = np.arange(32) + 0.5
    fills = {b: 5000 * 2.0 * math.exp(-0.4 * x) for b, x in enumerate(d)}
    a, k = studies.fit_intensity(dict.fromkeys(range(32), 5000.0), fills)
    assert abs(a - 2.0) < 0.01 and abs(k - 0.4) < 0.01
    assert studies.fit_intensity({}, {}, 1.5, 0.2) == pytest.approx((1.5, 0.2))  # without data, the prior


def test_token_books_and_windows(spark):
    q = [(0, 0, 1, 1, 4000, 4500, 10, 20), (1, 0, 2, 2, 4000, 5000, 10, 5), (0, 0, 3, 3, 4000, 4400, 10, 30), (1, 0, 4, 4, 4000, 5700, 10, 5)]
    quotes = spark.createDataFrame(q, "token long, grp long, seq long, ts_us long, bid long, ask long, bid_size long, ask_size long")
    groups = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "grp long, token long, leg int")
    r = pm.windows(pm.edges(quotes, groups, 2)).first()
    assert (r["buying"], r["open_us"], r["close_us"], r["open_edge"], r["max_edge"], r["size_at_max"]) == (True, 2, 4, 500, 600, 5)
    assert pm.components([[1, 2], [2, 3], [7, 8]]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


@pytest.mark.parametrize("text,want", [("0.5", 5000), ("1", 10000), ("0.12349", 1234), (".25", 2500), ("1.0001", -1), ("x", -1), ("", -1), ("-0.1", -1), ("0", 0)])
def test_price_parse(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fm.pm_price(F.col("t")).alias("p")).first()["p"] == want


def test_taker_fees_round_half_up(spark):
    df = spark.createDataFrame([(1_000_000, 5000, 20_000), (1_000_000, 1, 1), (3_000_000, 3333, 72_000)], "s long, p long, r long")
    got = col(df.select(fm.taker_fee(F.col("s"), F.col("p"), F.col("r"), 1).alias("f")), "f")
    assert got == [500, 0, 4800] == [pm_exec.taker_fee(s, p, r) // 10**5 for s, p, r in ((1_000_000, 5000, 20_000), (1_000_000, 1, 1), (3_000_000, 3333, 72_000))]


def test_accounts_identity(spark):
    r = random.Random(1)
    fills = [(1, k, r.randrange(-50, 50), 1000 + r.randrange(-5, 5), 2000 + r.randrange(-20, 20)) for k in range(200)]
    a = stats.accounts(spark.createDataFrame(fills, "run long, seq long, signed long, price long, mid2 long"))
    assert a.where("profit2 <> spread2 + drift2").count() == 0


def test_drawdown_starts_from_zero(spark):
    c = spark.createDataFrame([(1, k, x) for k, x in enumerate([-5, -2, 3, 1, 0, 4])], "run long, step long, total long")
    r = stats.drawdowns(c).first()
    assert (r["max_drawdown"], r["longest_underwater"]) == (5, 2)


def test_risk_statistics_against_plain_python(spark):
    r = random.Random(9)
    curves = {k: np.cumsum([r.gauss(0.1 * k, 1) for _ in range(100)]) for k in range(1, 5)}
    df = spark.createDataFrame([(k, i, float(x)) for k, c in curves.items() for i, x in enumerate(c)], "run long, step long, total double")
    got = {x["run"]: x for x in stats.deflated(stats.risk(df)).collect()}
    for k, c in curves.items():
        x = np.diff(np.concatenate([[0], c]))
        s = x.mean() / x.std(ddof=1)
        z = (x - x.mean()) / x.std()
        d = 1 - (z**3).mean() * s + ((z**4).mean() - 1) / 4 * s * s
        assert got[k]["sharpe"] == pytest.approx(s) and got[k]["psr"] == pytest.approx(0.5 * math.erfc(-s * math.sqrt(99 / d) / math.sqrt(2)), abs=1e-6)
        assert got[k]["dsr"] < got[k]["psr"] and got[k]["trials"] == 4
    assert stats.expected_best(1.0, 1) == 0


def test_models(spark):
    one = spark.range(1)
    k = one.select(models.kyle(F.lit(2.0), F.lit(4.0)).alias("m")).first()["m"]
    assert (k["beta"], k["impact"], k["insider_profit"]) == (2.0, 0.25, 4.0)
    g = one.select(models.glosten_milgrom(F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(0.2)).alias("m")).first()["m"]
    assert g["ask"] == pytest.approx(0.6) and g["bid"] == pytest.approx(0.4)
    path = one.select(models.glosten_milgrom_path(F.lit(0.5), F.lit(0.2), F.array(F.lit(True), F.lit(False))).alias("m")).first()["m"]
    assert path == pytest.approx([0.5, 0.6, 0.5])
    a = one.select(models.almgren_chriss(F.lit(100.0), F.lit(5.0), 5, F.lit(1.0), F.lit(0.1), F.lit(0.01), F.lit(0.0)).alias("m")).first()["m"]
    assert a["holdings"] == pytest.approx([100, 80, 60, 40, 20, 0]) and a["cost"] == pytest.approx(0.01 * 5000 + (0.1 - 0.005) * 5 * 400)


def test_normal_cdf(spark):
    xs = [-37.0, -8.0, -3.0, -2.999, -1.0, 0.0, 0.5, 2.5, 3.0, 6.0]
    got = col(spark.createDataFrame([(x,) for x in xs], "x double").select(fm.normal_cdf(F.col("x")).alias("p")), "p")
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=1e-12)
    ps = [1e-12, 1e-4, 0.3, 0.5, 0.975, 1 - 1e-9]
    back = spark.createDataFrame([(x,) for x in [*ps, 0.0, 1.0]], "p double").select(fm.normal_quantile(F.col("p")).alias("x"))
    assert [0.5 * math.erfc(-x / math.sqrt(2)) for x in col(back, "x")[: len(ps)]] == pytest.approx(ps, rel=1e-9) and col(back, "x")[len(ps) :] == [None, None]


def test_clock_round_trip(spark):
    df = spark.createDataFrame([("09:30:00.5",), ("23:59:59",), ("bad",)], "t string").select(fm.clock_to_ns(F.col("t")).alias("n"))
    assert col(df, "n") == [34_200_500_000_000, 86_399_000_000_000, None]
    assert col(df.select(fm.ns_to_clock(F.col("n")).alias("c")), "c")[:2] == ["09:30:00.500", "23:59:59.000"]


def test_matching_rules():
    m = sim.Matching()
    m.submit(1, 1, "S", 100, 101)
    m.submit(2, 2, "S", 100, 101)
    assert m.submit(3, 3, "B", 150, 101) == [("fill", 3, 1, 100, 101), ("fill", 3, 2, 50, 101)]
    assert m.submit(4, 4, "B", 10, 101, post_only=True)[0][0] == "reject"
    assert m.submit(5, 5, "B", 80, None)[-1] == ("cancel", 5, None, 30, None)
    assert m.reduce(2, 2, 5)[0][0] == "reject"  # it is gone
    for stp, kinds in (("cancel_new", ["cancel"]), ("cancel_old", ["cancel", "accept"]), ("cancel_both", ["cancel", "cancel"]), ("decrement", ["decrement"])):
        e = sim.Matching(stp)
        e.submit(1, 1, "S", 100, 101)
        assert [x[0] for x in e.submit(2, 1, "B", 100, 101)] == kinds
    e = sim.Matching(lock="slide")
    e.submit(1, 1, "S", 100, 1000)
    assert e.submit(2, 2, "B", 10, 1000, post_only=True) == [("accept", 2, None, 10, 900)]


def test_matching_keeps_shares(spark):
    r = random.Random(6)
    m, sent, done = sim.Matching(), 0, 0
    for k in range(2000):
        n = r.randrange(1, 50)
        sent += n
        for kind, _, _, shares, _ in m.submit(k, r.randrange(5), "BS"[r.randrange(2)], n, 100 + r.randrange(-3, 4), ioc=r.random() < 0.1):
            done += 2 * shares if kind == "fill" else shares if kind in ("cancel", "reject") else 0
    assert sent == done + sum(o[3] for o in m.orders.values())
    assert (m.best("B") or 0) < (m.best("S") or 1 << 40)


def test_virtual_orders_wait_for_the_queue():
    x = sim.ReplayExchange()
    x.start()
    x.on_message({"msg_type": "A", "ref": 1, "side": "B", "shares": 100, "price": 10})
    x.on_message({"msg_type": "A", "ref": 2, "side": "S", "shares": 100, "price": 12})
    assert x.submit(99, "B", 10, 50) == [] and x.queue_ahead(99) == 100
    x.on_message({"msg_type": "A", "ref": 3, "side": "B", "shares": 100, "price": 10})
    assert x.on_message({"msg_type": "E", "ref": 1, "shares": 60}) == [] and x.queue_ahead(99) == 40
    assert x.on_message({"msg_type": "E", "ref": 1, "shares": 40}) == [] and x.queue_ahead(99) == 0
    assert x.on_message({"msg_type": "E", "ref": 3, "shares": 70}) == [(99, 50, 10, True)]
    assert x.submit(98, "B", 12, 30) == [(98, 30, 12, False)]
    assert x.submit(97, "B", 12, 90) == [(97, 70, 12, False)]  # what was taken is not there again
    assert x.submit(96, "B", 12, 90, post_only=True) == [] and 96 not in x.mine and x.submit(95, "B", 12, 9, ioc=True) == [] and 95 not in x.mine


def test_virtual_orders_sweep_all_levels_and_share_an_execution():
    x = sim.ReplayExchange()
    x.start()
    for k in range(12):
        x.on_message({"msg_type": "A", "ref": k, "side": "S", "shares": 10, "price": 100 + k})
    assert sum(n for _, n, _, _ in x.submit(90, "B", 200, 125)) == 120 and x.mine[90].left == 5
    y = sim.ReplayExchange()
    y.start()
    y.submit(90, "B", 10, 30)
    y.submit(91, "B", 10, 30)
    y.submit(92, "B", 11, 10)
    y.on_message({"msg_type": "A", "ref": 5, "side": "B", "shares": 100, "price": 10})
    assert y.on_message({"msg_type": "E", "ref": 5, "shares": 60}) == [(92, 10, 11, True), (90, 30, 10, True), (91, 20, 10, True)]
    assert y.counts["diverted"] == 60 and y.counts["through"] == 1
    assert y.on_message({"msg_type": "P", "ref": None, "side": "B", "shares": 4, "price": 10}) == [(91, 4, 10, True)] and y.counts["hidden"] == 1
    z = sim.ReplayExchange("through")
    z.start()
    z.submit(90, "S", 10, 30)
    z.on_message({"msg_type": "A", "ref": 5, "side": "S", "shares": 100, "price": 10})
    z.on_message({"msg_type": "A", "ref": 6, "side": "S", "shares": 100, "price": 11})
    assert z.on_message({"msg_type": "E", "ref": 5, "shares": 60}) == [] and z.on_message({"msg_type": "E", "ref": 6, "shares": 60}) == [(90, 30, 10, True)]


def test_backtests_are_deterministic_and_idle_ones_earn_nothing(spark):
    m = flows.generate(spark, "queue_reactive", 5, 2, 1500)
    runs = [("zero", {}), ("naive", {}), ("microprice", {"half": 0.0})]
    a, b = (sim.sweep(m, runs).orderBy("run", "symbol").collect() for _ in range(2))
    assert a == b
    assert all(r["total"] == 0 and r["orders"] == 0 for r in a if r["strategy"] == "zero") and any(r["fills"] for r in a)
    assert [r["fills"] for r in a if r["run"] == 1] == [r["fills"] for r in a if r["run"] == 2]  # no margin: the micro-price joins as the naive one does


def test_reports_may_repeat_come_early_or_late():
    o = pm_exec.Oms()
    assert o.on_report(1, "fill", 7, 40) == 0
    o.submit(pm_exec.Order(1, 0, True, 5000, 100))
    assert o.orders[1].filled == 40 and o.on_report(1, "fill", 7, 40) == 0
    assert o.cancel(1) and not o.cancel(1)
    o.on_report(1, "cancelled")
    assert o.on_report(1, "fill", 8, 100) == 60 and o.orders[1].state == "filled"


def test_ledger_identity_and_reversal():
    r = random.Random(8)
    book_, held = pm_exec.Ledger(), {0: 0, 1: 0}
    for k in range(500):
        t = r.randrange(2)
        n = r.randrange(1, 50)
        signed = -min(n, held[t]) if r.random() < 0.4 else n
        if not signed:
            continue
        before = (book_.cash, book_.realised, book_.position[t], book_.cost[t])
        book_.fill(k, t, signed, r.randrange(1, 9999), r.randrange(5))
        if r.random() < 0.2:
            assert book_.failed(k) and (book_.cash, book_.realised, book_.position[t], book_.cost[t]) == before and not book_.failed(k)
        else:
            held[t] += signed
            assert book_.settled(k)
        assert book_.balanced()
    both = min(held.values())
    book_.merge([0, 1], both)
    book_.split([0, 1], 7)
    assert book_.balanced()
    book_.resolve(0, [0, 1])
    assert book_.balanced() and not sum(book_.position.values())


def test_risk_names_the_first_refusal():
    k = pm_exec.Risk(max_order=100, per_second=1, burst=2, tokens=2)
    ask = dict(position=0, gross=0, open_orders=0, total=0, mid=5000)
    assert k.check(0, True, 5000, 101, **ask) == "order_size" and k.check(0, True, 0, 10, **ask) == "price" and k.check(0, False, 5000, 10, **ask) == "short"
    assert k.check(0, True, 5000, 10, **ask) is None and k.check(0, True, 5000, 10, **ask) is None and k.check(0, True, 5000, 10, **ask) == "rate" and k.check(1, True, 5000, 10, **ask) is None
    k.killed = True
    assert k.check(9, True, 5000, 10, **ask) == "killed"


def test_arbitrage_plans():
    assert pm_exec.arb_plan([4000, 5000], [30, 20], 10**9, [0, 0]) == (20, 20 * 1000)
    assert pm_exec.arb_plan([4000, 6000], [30, 20], 10**9, [0, 0]) is None and pm_exec.arb_plan([4000, None], [1, 1], 1, [0, 0]) is None
    assert pm_exec.arb_plan([4999, 5000], [10**8, 10**8], 10**15, [72_000, 72_000]) is None  # fees eat it
    assert pm_exec.walk([(10, 5), (11, 5)], 7) == (7, 72)
    assert pm_exec.choose([10, 0], [1, 4000], [5000, 1], 10**9)[0] == "complete" and pm_exec.choose([10, 0], [1, 9000], [5000, 1], 10**9)[0] == "unwind"


def maker_session(faults=None, quoter="skew", **maker):
    s = pm_exec.Session(quoter, pm_exec.Maker(warm_s=0, **maker), faults)
    r = random.Random(4)
    for k in range(600):
        b = 4800 + r.randrange(40) * 10
        s.quote(k * 200_000, k % 2, b, 10**8, b + 100, 10**8)
        s.trade(k * 200_000 + 1, k % 2, b, 10**8)
    s.finish()
    return s


def test_venue_faults_leave_the_same_books():
    for faults in (None, {"repeat": 2}, {"repeat": 3, "delay": 4}, {"fail": 3, "delay": 5, "repeat": 2}, {"lose": 7, "refuse": 50}):
        s = maker_session(faults)
        assert s.ledger.balanced() and all(o.filled <= o.size for o in s.oms.orders.values()) and s.maker_fills + s.taker_fills > 0
        assert s.ledger.position == s.venue.position and s.risk.why is None and not s.ledger.pending and not s.ledger.orphans
    assert maker_session().digest == maker_session().digest
    assert maker_session(fee_ppm=20_000).ledger.fees >= maker_session().ledger.fees == 0


def test_kill_switch():
    r = pm_exec.Risk(reject_spike=2, daily_stop=100)
    for now in (0.0, 1.0, 20.0, 21.0):
        r.on_reject(now)
    assert not r.killed
    r.on_reject(22.0)
    assert r.why == "rejects" and r.check(23.0, True, 5000, 1, position=0, gross=0, open_orders=0, total=0, mid=None) == "killed"
    r.on_tick(-500, 0)
    assert r.why == "rejects"  # the first reason stands
    q = pm_exec.Risk(daily_stop=100)
    q.on_tick(50, -101)
    assert q.why == "loss"
    s = maker_session({"refuse": 1})
    assert s.risk.why == "rejects" and s.halted and all(o.state in pm_exec.FINAL for o in s.oms.orders.values())


def test_settlements_may_come_first_and_repeat():
    k = pm_exec.Ledger()
    assert not k.settle(1, False)
    k.fill(1, 0, 10, 5000, 7)
    assert k.position[0] == 0 and k.cash == k.fees == 0 and not k.settle(1, False)
    k.fill(2, 0, 10, 5000, 7)
    assert k.settle(2, True) and not k.settle(2, False) and k.position[0] == 10


def test_orders_that_nothing_is_heard_of():
    o = pm_exec.Oms()
    o.submit(pm_exec.Order(1, 0, True, 5000, 100, sent_at=0))
    o.submit(pm_exec.Order(2, 0, True, 5000, 100, sent_at=90))
    assert o.on_timer(100, 50) == [1] and o.orders[1].state == "unknown" and o.cancel_all() == [1, 2] and o.cancel_all() == []


def test_quoters_and_variants(spark):
    v = pm_exec.QuoteView(4900, 5100, 0.5, 0.0, 1e-4, pm_exec.Maker())
    b, a = pm_exec.maker_quote("logit", v)
    risk, half = 0.1 * 1e-4 * 3600, math.log1p(0.1 / 30) / 0.1
    assert b == math.floor(1e4 / (1 + math.exp(risk / 2 + half)) / 10) * 10 and a == 10_000 - b
    v.inventory = 2.0
    assert pm_exec.maker_quote("skew", v) == (4960, 5000)
    v.inventory = 5.0
    assert pm_exec.maker_quote("skew", v)[0] is None
    v.mid = 0.99
    assert pm_exec.maker_quote("skew", v) == (None, None)
    assert len(pm_exec.variants(["logit", "skew"], gamma=[0.1, 0.2], k=[10, 30])) == 8
    for bad in (dict(gamma=list(range(1, 300))), dict(quoters=["none"]), dict(gamma=[-1.0])):
        with pytest.raises(ValueError):
            pm_exec.variants(**bad)
    rows = [(0, 0, k, k * 10**6, 4800 + k % 7 * 10, 4900 + k % 7 * 10, 100, 100) for k in range(300)]
    q = spark.createDataFrame(rows, "grp long, token long, seq long, ts_us long, bid long, ask long, bid_size long, ask_size long")
    out = pm_exec.replay(q, runs=pm_exec.variants(["skew"], size=[10_000_000, 20_000_000])).orderBy("run").collect()
    assert [r["run"] for r in out] == [0, 1] and all(r["balanced"] for r in out) and out[0]["maker_fills"] > 0


def test_recordings(spark, tmp_path):
    d = tmp_path / "c0"
    d.mkdir()
    (d / "h.jsonl").write_text(
        '1 {"event_type": "book", "asset_id": "7", "bids": [{"price": "0.4", "size": "10"}], "asks": [{"price": "0.6", "size": "5"}]}\n'
        '2 [{"event_type": "price_change", "price_changes": [{"asset_id": "7", "price": "0.41", "size": "3", "side": "BUY", "best_bid": "0.41", "best_ask": "0.6"}]}]\n'
        '5 {"event_type": "last_trade_price", "asset_id": "7", "price": "0.6", "size": "2", "side": "BUY"}\n'
        "9 not json\n"
    )
    raw = recordings.lines(spark, str(tmp_path))
    changes = recordings.level_changes(recordings.events(raw)).orderBy("recv_ns", "at").collect()
    assert [(r["kind"], r["token"], r["buy"], r["px"], r["size"]) for r in changes] == [("snapshot", "7", True, 4000, 10.0), ("snapshot", "7", False, 6000, 5.0), ("change", "7", True, 4100, 3.0)]
    assert recordings.trades(recordings.events(raw)).first()["px"] == 6000
    q = recordings.quality(raw).first()
    assert (q["conn"], q["lines"], q["bad"], q["max_gap_ns"]) == ("c0", 4, 1, 4)
    (tmp_path / "s.tsv").write_text("token\t1\tc0\tYes\ntoken\t2\tc0\tNo\ngroup\tg\t1\t2\n")
    tokens, groups = recordings.session(spark, str(tmp_path / "s.tsv"))
    assert tokens.count() == 2 and sorted(map(tuple, groups.select("grp", "leg", "token").collect())) == [("g", 0, "1"), ("g", 1, "2")]


def test_lobster_files(spark, tmp_path):
    m = flow(spark, 60)
    rows = book.lobster(m, book.order_lives(m))
    depth = kernels.depth_sweep(m, 2).select("symbol", "seq", "bids", "asks")
    recordings.write_lobster(rows, depth, str(tmp_path), 2)
    a, b = (sorted(r["value"] for r in spark.read.text(str(tmp_path / n)).collect()) for n in ("message", "book"))
    assert len(a) == len(b) == rows.count() and all(len(x.split(",")) == 6 for x in a) and all(len(x.split(",")) == 8 for x in b)


def test_philox_known_answer():
    assert [hex(x) for x in flows.philox(np.zeros((1, 4), np.uint32), (0, 0))[0].tolist()] == ["0x6627e8d5", "0xe169c58d", "0xbc57ac4c", "0x9b00dbd8"]


def test_upper_median_and_bootstrap(spark):
    df = spark.createDataFrame([(1, x) for x in (4, 1, 3, 2)] + [(2, 5), (2, None)], "g long, x long")
    assert {r["g"]: r["upper_median"] for r in micro.upper_median(df, "x", ["g"]).collect()} == {1: 3, 2: 5}
    b = stats.bootstrap_median(df.where("g = 1"), "x", 200, 5, 194).first()
    assert b["low"] <= b["median"] == 2.5 <= b["high"]


def test_bootstrap_draws_by_hash_and_keeps_them_in_tasks(spark):
    """Draws as Spark's hash makes them; their number is no reason for a broadcast (2,000 replicates, 2.4 million draws)."""
    n, reps = 1201, 2000
    hashed = spark.range(3).select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("at")).select("id", "at", F.pmod(F.xxhash64(F.lit(1), "id", "at"), F.lit(n)).alias("i")).toPandas()
    for rep, own in hashed.groupby("id"):
        assert stats.draws(1, int(rep), 0, n, n).tolist() == own.sort_values("at")["i"].tolist()
    x = np.random.default_rng(5).normal(size=n).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    medians = np.sort([np.median(np.sort(x)[stats.draws(1, rep, 0, n, n)]) for rep in range(reps)])
    b = stats.bootstrap_median(df, "x", reps, 50, 1949)
    assert "Join" not in b._jdf.queryExecution().toString()
    assert b.first().asDict() == {"low": medians[50], "high": medians[1949], "median": np.median(x)}
    few = stats.bootstrap_median(df.limit(6), "x", 9, 0, 9).first()
    assert few["median"] == pytest.approx(np.median(x[:6])) and few["low"] is not None and few["high"] is None
    assert stats.bootstrap_median(df.where("false"), "x").first().asDict() == {"low": None, "high": None, "median": None}


def test_rank_of_draws_takes_any_number_of_bins(monkeypatch):
    monkeypatch.setattr(stats, "BINS", 7)
    monkeypatch.setattr(stats, "DRAWN", 100)
    want = np.sort(stats.draws(1, 4, 0, 1000, 1000))
    assert [stats.drawn_at_rank(1, 4, 1000, k) for k in (0, 499, 500, 999)] == want[[0, 499, 500, 999]].tolist()


def test_frontier_prefers_the_better_run():
    got = stats.frontier([1.0, 0.1], [[1.0, 0.0], [0.0, 1.0]])
    assert got["best_ratio"] == pytest.approx([1 / 1.1, 0.1 / 1.1]) and got["least_risk"] == pytest.approx([0.5, 0.5])


def test_frontier_leaves_out_what_does_not_pay():
    cov = [[1.0, 0.9, 0.0], [0.9, 1.0, 0.0], [0.0, 0.0, 4.0]]
    got = stats.frontier([1.0, 0.5, -1.0], cov)
    assert got["best_ratio"] == pytest.approx([1.0, 0.0, 0.0])
    grid = [(a / 50, b / 50, 1 - a / 50 - b / 50) for a in range(51) for b in range(51 - a)]
    risk = lambda w: sum(w[i] * w[j] * cov[i][j] for i in range(3) for j in range(3))
    assert risk(got["least_risk"]) <= min(map(risk, grid)) + 1e-9 and sum(got["least_risk"]) == pytest.approx(1.0)
    assert stats.frontier([-1.0, -2.0], [[1.0, 0.0], [0.0, 1.0]])["best_ratio"] == [1.0, 0.0]


def test_orders_end_when_their_shares_run_out(spark):
    """A chain of three references; the last one is executed in full, another order is cancelled in full."""
    m = spark.createDataFrame(
        [(1, 1, "A", 10, None, "S", 100, 500), (1, 2, "U", 10, 11, None, 80, 510), (1, 3, "U", 11, 12, None, 60, 520), (1, 4, "E", 12, None, None, 20, None), (1, 5, "E", 12, None, None, 40, None), (1, 6, "A", 13, None, "B", 5, 490), (1, 7, "X", 13, None, None, 5, None)],
        "symbol long, seq long, msg_type string, ref long, new_ref long, side string, shares long, price long",
    ).selectExpr("*", "seq * 10 as ts_us")
    got = {r["ref"]: (r["side"], r["end_seq"], r["end_kind"]) for r in book.order_lives(m).collect()}
    assert got == {10: ("S", 2, "U"), 11: ("S", 3, "U"), 12: ("S", 5, "E"), 13: ("B", 7, "X")}
    assert book.full_depth(book.level_deltas(m, book.order_lives(m))).count() == 0
    assert {r["rule"]: r["broken"] for r in book.invariants(book.level_deltas(m, book.order_lives(m)), book.order_lives(m)).collect()} == {"negative_level": 0, "level_sum": 0}


def test_realism_measures(spark):
    a, b = (spark.createDataFrame([(float(x + k),) for x in range(100)], "x double") for k in (0, 1000))
    assert micro.total_variation(a, b, "x", 10).first()["tv"] == 1.0 and micro.total_variation(a, a, "x", 10).first()["tv"] == 0.0
    sd = np.std(np.arange(100), ddof=1)
    half = spark.createDataFrame([(x + 0.5,) for x in range(100)], "x double")
    assert micro.wasserstein(a, half, "x", 100).first()["w1"] == pytest.approx(0.5 / sd, abs=1e-6)
    alt = spark.createDataFrame([(1, k, float(k % 2)) for k in range(100)], "g long, k long, x double")
    assert micro.autocorrelation(alt, "x", "g", "k", 1).first()["acf"] == pytest.approx(-0.99) and micro.moments(alt, "x", ["g"]).first()["kurt"] == pytest.approx(1.0)


def test_ridge_and_component(spark):
    r = random.Random(2)
    rows = []
    for _ in range(400):
        f = r.gauss(0, 1)
        a, b = f + r.gauss(0, 0.01), f + r.gauss(0, 0.01)
        rows.append((a, b, 2 + 3 * a - b))
    df = spark.createDataFrame(rows, "a double, b double, y double")
    w, share = micro.first_component(df, ["a", "b"])
    assert w == pytest.approx([0.5, 0.5], abs=0.01) and share > 0.99
    assert micro.ridge(df, ["a", "b"], "y", 1e-9) == pytest.approx([2, 3, -1], abs=1e-3)


def test_counts_of_a_file_with_a_directory_and_a_cut_end(spark, tmp_path):
    head = {"locate": 7, "ts_ns": 5}
    good = [{"msg_type": "A", "ref": 1, "side": "B", "shares": 5, "stock": "OTHER", "price": 10} | head, {"msg_type": "R", "stock": "NAME", "category": "Q", "round_lot": 100} | head]
    data = b"".join(itch.encode(m) for m in good) + b"\x00\x02?!" + b"\x00\x24A"
    (tmp_path / "day").write_bytes(data)
    m = itch.read_days(spark, str(tmp_path / "day")).cache()
    assert itch.file_counts(m).select("frames", "bad", "trailing").collect() == [(3, 1, 3)]
    assert m.where("msg_type = 'R'").select("stock", "category", "round_lot").collect() == [("NAME", "Q", 100)]
    assert {r["status"] for r in itch.split_rejects(m)[1].collect()} == {"unknown_type"}
    itch.ingest(m, str(tmp_path / "store"), "2025-01-02")
    assert itch.symbol_scan(spark, str(tmp_path / "store"), "2025-01-02", "NAME").count() == 2


def test_settings_are_strict():
    known = {"gamma": settings.Bound(0, 1), "runs": settings.Bound(1, 9, True)}
    assert settings.parse("# none\n gamma = 0.5 # half\r\n\nruns=3", known) == {"gamma": 0.5, "runs": 3}
    for text, why in (("gamma", "expected"), ("x = 1", "unknown"), ("gamma=1\ngamma=1", "t:2: repeated"), ("gamma = 1a", "not a number"), ("gamma = nan", "not a number"), ("gamma =", "not a number"), ("runs = 1.5", "integer"), ("gamma = 2", "outside")):
        with pytest.raises(ValueError, match=why):
            settings.parse(text, known, "t")


def test_ids_lines_and_dates(spark):
    df = spark.createDataFrame([("12",), ("",), ("1a",), ("1\n",), ("9" * 101,), (None,)], "x string")
    assert col(df.select(fm.valid_id(F.col("x")).alias("g")), "g") == [True, False, False, False, False, False]
    assert col(df.select(fm.one_line(F.col("x")).alias("g")), "g")[3] == "1 "
    paths = spark.createDataFrame([("a/2012-06-21/x",), ("a/S062112/20240131_34200000",), ("a/b",), ("a/20241340",), (None,)], "p string")
    assert [str(d) if d else None for d in col(paths.select(fm.path_date(F.col("p")).alias("d")), "d")] == ["2012-06-21", "2024-01-31", None, None, None]


def test_recordings_are_compacted_to_whole_lines(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "h.jsonl").write_bytes(b'1 {"a": 1}\n2 {"b": [1, 2]}\n3 {"a": \n\x00\x00\x00')
    got = recordings.compact(spark, str(tmp_path / "raw"), str(tmp_path / "out")).collect()
    assert got == [(4, 2)] and sorted(col(spark.read.text(str(tmp_path / "out")), "value")) == ['1 {"a": 1}', '2 {"b": [1, 2]}']


def test_session_files_round_trip(spark, tmp_path):
    text = "token\t11\tc1\tYes\t0.01\t5.0\t1\t0\t200\t1\t30\ntoken\t12\tc1\tNo\t0.01\t5.0\t1\t0\t200\t1\t30\ngroup\tg\t12\t11\n"
    (tmp_path / "s").write_text(text)
    tokens, groups = recordings.session(spark, str(tmp_path / "s"))
    recordings.write_session(tokens, groups, str(tmp_path / "again"))
    back = recordings.session(spark, str(tmp_path / "again"))
    assert back[0].collect() == tokens.orderBy("token").collect() and back[1].orderBy("leg").collect() == groups.orderBy("leg").collect()


def test_runs_written_and_listed(spark, tmp_path):
    fills = spark.createDataFrame([("a", 10, 5, 100), ("a", 70, -2, 101), ("b", 5, 1, 7)], "run string, ts_us long, signed long, price long")
    line = runs.timeline(fills, 60).orderBy("run", "bucket").collect()
    assert [tuple(r) for r in line] == [("a", 0, 1, 5, 5, -500), ("a", 1, 1, 2, 3, -298), ("b", 0, 1, 1, 1, -7)]
    why = spark.createDataFrame([("a", "rate"), ("a", "rate")], "run string, reason string")
    for name in ("first", "second"):
        runs.write_session_report(fills, why, studies.latency_histogram(fills, "ts_us"), fills.groupBy("run").count(), str(tmp_path / name), 60)
    assert spark.read.option("header", "true").csv(str(tmp_path / "first" / "filters")).collect() == [("a", "rate", "2")]
    board = runs.leaderboard(spark, str(tmp_path), 3).collect()
    assert len(board) == 3 and board[0]["run_path"] == "second"
