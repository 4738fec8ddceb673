import math

import pytest
from pyspark.sql import functions as F

from bookweave.operators import pnl as P
from bookweave.operators import risk as R

ONE = 1_000_000


def fills(spark, rows):
    data = [(1, s, p * ONE, q * ONE, i, i) for i, (s, q, p) in enumerate(rows)]
    return spark.createDataFrame(data, "symbol_id int, side int, price_fp long, qty_fp long, ts_ns long, seq long")


@pytest.mark.parametrize(
    "rows, net, avg, pnl",
    [
        ([(0, 10, 100)], 10, 100, 0),
        ([(1, 10, 100)], -10, 100, 0),
        ([(0, 10, 100), (0, 10, 200)], 20, 150, 0),
        ([(0, 10, 100), (1, 10, 120)], 0, 0, 200),
        ([(0, 10, 100), (1, 10, 80)], 0, 0, -200),
        ([(0, 10, 100), (1, 15, 120)], -5, 120, 200),
        ([(1, 10, 100), (0, 4, 90)], -6, 100, 40),
    ],
)
def test_positions(spark, rows, net, avg, pnl):
    r = P.positions(fills(spark, rows)).first()
    assert (r.net_qty_fp, r.avg_entry_price_fp, r.realized_pnl_fp) == (net * ONE, avg * ONE, pnl * ONE)


def test_positions_in_many_rounds(spark):
    import random

    rng = random.Random(5)
    data = [(1 if rng.random() < 0.7 else rng.randrange(2, 9), rng.randrange(2), rng.randrange(1, 10**9), rng.randrange(1, 10**8), i, i) for i in range(400)]
    df = spark.createDataFrame(data, "symbol_id int, side int, price_fp long, qty_fp long, ts_ns long, seq long")
    state = {}
    for s, side, p, q, t, _ in data:
        net, avg, pnl = state.get(s, (0, 0, 0))
        state[s] = P.apply_fill(net, avg, pnl, side, p, q, ONE)
    got = {r.symbol_id: (r.net_qty_fp, r.avg_entry_price_fp, r.realized_pnl_fp) for r in P.positions(df, 50).collect()}
    assert got == state


def trades(spark, pnls):
    return spark.createDataFrame([(float(p), i, i) for i, p in enumerate(pnls)], "pnl double, exit_ts_ns long, seq long")


def test_report_closed_forms(spark):
    r = P.report(trades(spark, [0, 2] * 4), []).first()
    std = math.sqrt(sum((x - 1) ** 2 for x in [0, 2] * 4) / 7)
    assert r.sharpe_ratio == pytest.approx(1 / std * math.sqrt(252))
    assert r.sortino_ratio == math.inf and r.profit_factor == math.inf
    assert r.total_trades == 8 and r.win_rate == 0.5
    r = P.report(trades(spark, [3]), []).first()
    assert (r.sharpe_ratio, r.sortino_ratio) == (0, 0)
    r = P.report(trades(spark, []), []).first()
    assert (r.total_pnl, r.win_rate, r.profit_factor, r.sharpe_ratio) == (0, 0, 0, 0)


def test_max_drawdown(spark):
    assert P.max_drawdown(trades(spark, [1, 1, 1]), [], ["exit_ts_ns", "seq"]).first()[0] == 0
    assert P.max_drawdown(trades(spark, [10, -4, -1, 20]), [], ["exit_ts_ns", "seq"]).first()[0] == pytest.approx(50)
    assert P.max_drawdown(trades(spark, [-5, 3]), [], ["exit_ts_ns", "seq"]).first()[0] == 0


@pytest.mark.parametrize(
    "day, week, pnl, n_rows, reason",
    [
        (5, 10, [5000, -3000], 2, None),
        (5, 10, [5000, -6000], 2, "Daily drawdown 6.00% >= 5% threshold"),
        (20, 5, [3000, -9000], 2, "Weekly drawdown 9.00% >= 5% threshold"),
        (2, 10, [1000, -3000, 100000], 2, "Daily drawdown 3.00% >= 2% threshold"),
    ],
)
def test_drawdown_monitor(spark, day, week, pnl, n_rows, reason):
    df = spark.createDataFrame([(float(p), i, i) for i, p in enumerate(pnl)], "pnl_usd double, ts_ns long, seq long")
    rows = sorted(R.drawdown_monitor(df, day, week, 100_000.0).collect(), key=lambda r: r.seq)
    assert len(rows) == n_rows and rows[-1].break_reason == reason


def test_fifo_skips_fills_without_an_order(spark):
    orders = spark.createDataFrame([("o1", 10, 1, 100), ("o2", 40, 4, 100)], "order_id string, ts_ns long, seq long, price_fp long")
    hits = spark.createDataFrame(
        [(5, 0, True, 100), (20, 2, False, 101), (30, 3, True, 102), (35, 33, True, 103), (50, 5, True, 99)],
        "ts_ns long, seq long, is_full boolean, price_fp long",
    )
    got = {r.seq: r.order_id for r in P.attribute_fills(orders, hits, []).collect()}
    assert got == {2: "o1", 3: "o1", 5: "o2"}


def test_risk_limits_one_by_one(spark):
    base = dict(symbol_id=1, notional=10.0, total_notional=0.0, symbol_notional=0.0, order_rate=0, cancel_rate=0, slippage_bp=0.0, drawdown_pct=0.0)
    cases = [
        ({}, []), ({"total_notional": 999_995.0}, ["Total notional"]), ({"symbol_notional": 199_995.0}, ["Symbol 1"]),
        ({"order_rate": 100}, ["Order rate", "Order rate"]), ({"order_rate": 80}, ["Order rate"]), ({"cancel_rate": 50}, ["Cancel rate"]),
        ({"slippage_bp": 10.5}, ["Cumulative slippage"]), ({"drawdown_pct": 5.5}, ["Session drawdown"]),
    ]
    df = spark.createDataFrame([{**base, **c, "case": i} for i, (c, _) in enumerate(cases)])
    for r in R.risk_check(df, R.RiskLimits()).collect():
        want = cases[r.case][1]
        assert r.allowed == (not want) and len(r.violations) == len(want)
        assert all(v.startswith(w) for v, w in zip(r.violations, want))


def test_latch_and_reset(spark):
    rows = [(1, None, False), (2, "a", False), (3, "b", False), (4, None, True), (5, None, False), (6, "c", False)]
    df = spark.createDataFrame([(t, t, w, x) for t, w, x in rows], "t long, seq long, why string, rs boolean")
    out = {r.t: r.active_reason for r in R.latch(df, [], ["t", "seq"], F.col("why"), F.col("rs")).collect()}
    assert out == {1: None, 2: "a", 3: "a", 4: None, 5: None, 6: "c"}


def test_cooldown_edge_sends(spark):
    df = spark.createDataFrame([("x", t, t) for t in (0, 5, 10, 12, 21)], "alert_type string, ts_ns long, seq long")
    assert {r.seq: r.sent for r in R.alert_cooldown(df, 10).collect()} == {0: True, 5: False, 10: True, 12: False, 21: True}
