"""Folds of a hot key, cut into bundles that run side by side, equal one fold over the whole key."""

import random

import pytest
from pyspark.sql import functions as F

from bookweave.operators import ordered as O
from bookweave.operators import pnl as P
from bookweave.operators import risk as R


def folded(rows):
    """seq -> (net, avg, pnl) of one symbol's fills in order."""
    net = avg = pnl = 0
    out = {}
    for side, price, qty, ts, seq in rows:
        net, avg, pnl = P.apply_fill(net, avg, pnl, side, price, qty, P.RISK_SCALE)
        out[seq] = (net, avg, pnl)
    return out


@pytest.mark.parametrize("size", [1_000_000, 40])
def test_positions(spark, size):
    rng = random.Random(6)
    fills = [("hot" if k % 5 else f"cold{k % 3}", rng.randrange(2), rng.randrange(1, 10**9), rng.choice([0, 1, 2, 3, 10**6]), k // 2, k) for k in range(700)]
    keys = sorted({f[0] for f in fills})
    df = spark.createDataFrame([(keys.index(f[0]), *f[1:]) for f in fills], "symbol_id int, side int, price_fp long, qty_fp long, ts_ns long, seq long").repartition(5)
    history, final = P.position_history(df, size)
    got = {r.seq: (r.net_qty_fp, r.avg_entry_price_fp, r.realized_pnl_fp) for r in history.collect()}
    want, last = {}, {}
    for name in keys:
        own = folded([f[1:] for f in fills if f[0] == name])
        want |= own
        last[keys.index(name)] = own[max(own)]
    assert got == want
    assert {r.symbol_id: (r.net_qty_fp, r.avg_entry_price_fp, r.realized_pnl_fp) for r in final.collect()} == last
    assert {r.symbol_id: r.last_fill_ts_ns for r in final.collect()} == {keys.index(n): max(f[4] for f in fills if f[0] == n) for n in keys}


@pytest.mark.parametrize("size", [1_000_000, 30])
def test_cooldown(spark, size):
    rng = random.Random(9)
    t, rows = 0, []
    for k in range(500):
        t += rng.choice([0, 1, 5, 9, 10, 11, 40])
        rows.append((0 if k % 7 else 1, t, k))
    df = spark.createDataFrame(rows, "alert_type int, ts_ns long, seq long").repartition(5)
    expiry, want = {}, {}
    for kind, ts, seq in rows:
        want[seq] = ts >= expiry.get(kind, -1)
        if want[seq]:
            expiry[kind] = ts + 10
    assert {r.seq: r.sent for r in R.alert_cooldown(df, 10, size).collect()} == want


def test_bundles_begin_where_they_may(spark):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("s"))
    cut = O.independent_bundles(rows, ["k"], ["t", "s"], F.col("t") % 10 == 0, 100)
    sizes = cut.groupBy("_bundle").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a")).orderBy("a").collect()
    assert len(sizes) == 10 and all(r.n == 100 and r.a % 10 == 0 for r in sizes)
