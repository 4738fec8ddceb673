"""Label queries: windows of 2 h every 30 min over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookweave.operators import labels as L
from bookweave.plans.catalog import query
from bookweave.sources.driver_tables import ME_SQL, market_events

W, S = 7_200_000_000_000, 1_800_000_000_000
ME = f"WITH {ME_SQL} "

# windows by a range join, returns by a lag inside the window: written apart from the Spark form
WIN = (
    ME
    + f""", b AS (SELECT min(ts_exchange_ns) AS lo, max(ts_exchange_ns) AS hi FROM me),
wn AS (SELECT k AS window_index, lo + k * {S} AS s, lo + k * {S} + {W} AS e FROM b, generate_series(0, 100000) AS g(k) WHERE lo + k * {S} + {W} <= hi),
m AS (SELECT window_index, s, e, me.* FROM wn JOIN me ON ts_exchange_ns >= s AND ts_exchange_ns < e),
nx AS (SELECT window_index, count(*) AS n_next, coalesce(avg(price_fp) FILTER (price_fp > 0), 0) AS next_mid
       FROM wn JOIN me ON ts_exchange_ns >= e AND ts_exchange_ns < e + {W} GROUP BY 1),
a AS (SELECT window_index, count(*) AS n_events, coalesce(avg(price_fp) FILTER (price_fp > 0), 0) AS mid,
             count(*) FILTER (price_fp > 0) AS n_prices, bool_or(event_type = 3) AS fill_occurred, bool_or(event_type = 2) AS cancel_occurred
      FROM m GROUP BY 1),
r0 AS (SELECT window_index, seq, price_fp, lag(price_fp) OVER (PARTITION BY window_index ORDER BY ts_exchange_ns, seq) AS pp FROM m WHERE price_fp > 0),
r AS (SELECT *, (price_fp - pp) / pp::DOUBLE AS ret FROM r0 WHERE pp IS NOT NULL),
rs AS (SELECT window_index, count(*) AS n_returns, avg(ret) AS mean, stddev_pop(ret) AS std, min(ret) AS mn, max(ret) AS mx FROM r GROUP BY 1),
sl AS (SELECT m.window_index, avg(abs(price_fp - mid) / mid * 10000) AS slip FROM m JOIN a USING (window_index) WHERE event_type = 3 AND mid > 0 GROUP BY 1),
lab AS (SELECT a.window_index, n_events, mid, coalesce(n_next, 0) AS n_next, n_prices, n_returns, std AS volatility, mean AS mean_return,
  CASE WHEN mid > 0 THEN (CASE WHEN n_next > 0 THEN next_mid ELSE mid END - mid) / mid * 10000 ELSE 0 END AS mid_price_move_bp,
  fill_occurred, cancel_occurred, coalesce(slip, 0) AS slippage_bp,
  coalesce(n_prices >= 3 AND n_returns >= 2 AND std <> 0 AND greatest(mx - mean, mean - mn) > 2 * std, false) AS vol_jump,
  CASE WHEN n_prices < 2 OR std IS NULL THEN 1 WHEN std < 0.0005 THEN 0 WHEN std < 0.002 THEN 1 ELSE 2 END AS regime_label
  FROM a LEFT JOIN nx USING (window_index) LEFT JOIN rs USING (window_index) LEFT JOIN sl USING (window_index)) """
)


def R(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "label_rows",
    "D17 C10 D10 D11 D12 D13 D14 D15 D16",
    WIN
    + f"SELECT window_index, {rounded('mid_price_move_bp', 'slippage_bp')}, fill_occurred, cancel_occurred, vol_jump, regime_label FROM lab",
)
def _(spark, d):
    rows = L.label_rows(market_events(spark, d), W, S)
    return rows.select(
        "window_index", *R("mid_price_move_bp", "slippage_bp"), "fill_occurred", "cancel_occurred", "vol_jump", "regime_label"
    )


@query("window_member_counts", "C9", WIN + "SELECT window_index, n_events FROM lab")
def _(spark, d):
    rows = L.window_members(market_events(spark, d).select("ts_exchange_ns", "event_id"), W, S)
    return rows.groupBy("window_index").agg(F.count(F.lit(1)).alias("n_events"))


@query("next_window_counts", "C10", WIN + "SELECT window_index, n_events, n_next FROM lab")
def _(spark, d):
    return L.next_window_counts(market_events(spark, d).select("ts_exchange_ns"), W, S)


@query("window_mid_prices", "D10", WIN + "SELECT window_index, round(mid, 2) AS mid FROM lab")
def _(spark, d):
    events = market_events(spark, d)
    rows = L.window_members(events.select("ts_exchange_ns", "price_fp"), W, S)
    mid = F.coalesce(F.avg(F.when(F.col("price_fp") > 0, F.col("price_fp").cast("double"))), F.lit(0.0))
    return rows.groupBy("window_index").agg(F.round(mid, 2).alias("mid"))


def _stats(spark, d):
    events = market_events(spark, d)
    return L.window_statistics(events, L.Windows.over(events, W, S))


@query("window_mid_moves", "D11", WIN + f"SELECT window_index, {rounded('mid_price_move_bp')} FROM lab")
def _(spark, d):
    return _stats(spark, d).select("window_index", F.round(L.mid_move_bp(), 6).alias("mid_price_move_bp"))


@query("window_fill_cancel", "D12", WIN + "SELECT window_index, fill_occurred, cancel_occurred FROM lab")
def _(spark, d):
    return _stats(spark, d).select("window_index", "fill_occurred", "cancel_occurred")


@query("window_slippage", "D13", WIN + f"SELECT window_index, {rounded('slippage_bp')} FROM lab")
def _(spark, d):
    events = market_events(spark, d)
    grid = L.Windows.over(events, W, S)
    return L.trade_slippage(events, L.window_statistics(events, grid), grid).select("window_index", *R("slippage_bp"))


@query(
    "window_volatility",
    "D14 D15 D16 E17",
    WIN + f"SELECT window_index, n_prices, coalesce(n_returns, 0) AS n_returns, {rounded('volatility', 'mean_return')}, vol_jump, regime_label FROM lab",
)
def _(spark, d):
    return _stats(spark, d).select(
        "window_index", "n_prices", "n_returns",
        F.round("ret_std", 6).alias("volatility"), F.round("ret_mean", 6).alias("mean_return"),
        L.vol_jump().alias("vol_jump"), L.regime_label().alias("regime_label"),
    )


@query(
    "stream_returns",
    "E17",
    ME
    + """SELECT seq, round((price_fp - p) / p::DOUBLE, 9) AS ret FROM (SELECT seq, price_fp, ts_exchange_ns, lag(price_fp) OVER (ORDER BY ts_exchange_ns, seq) AS p FROM me WHERE price_fp > 0)""",
)
def _(spark, d):
    return L.stream_returns(market_events(spark, d)).select("seq", F.round("ret", 9).alias("ret"))


@query(
    "train_val_split",
    "E27",
    WIN
    + "SELECT window_index, CASE WHEN row_number() OVER (ORDER BY window_index) <= floor((SELECT count(*) FROM lab) * 0.8) THEN 'train' ELSE 'val' END AS split FROM lab",
)
def _(spark, d):
    windows = L.next_window_counts(market_events(spark, d).select("ts_exchange_ns"), W, S).select("window_index")
    return L.split_train_val(windows, 0.2)


@query(
    "mini_batches",
    "E28",
    WIN + "SELECT window_index, (row_number() OVER (ORDER BY window_index) - 1) // 32 AS batch_id FROM lab",
)
def _(spark, d):
    windows = L.next_window_counts(market_events(spark, d).select("ts_exchange_ns"), W, S).select("window_index")
    return L.mini_batches(windows, 32)


@query(
    "walk_forward_folds",
    "E29",
    ME
    + """, x AS (SELECT event_id, ts_exchange_ns // 86400000000000 - min(ts_exchange_ns // 86400000000000) OVER () AS day FROM me),
 f AS (SELECT g AS fold FROM generate_series(0, 1000) AS t(g) WHERE g <= (SELECT max(day) + 1 - 6 FROM x))
 SELECT fold, CASE WHEN day < fold + 5 THEN 'train' ELSE 'val' END AS role, count(*) AS n FROM x JOIN f ON day >= fold AND day < fold + 6 GROUP BY 1, 2""",
)
def _(spark, d):
    rows = L.walk_forward(market_events(spark, d).select("event_id", "ts_exchange_ns"), "ts_exchange_ns")
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
