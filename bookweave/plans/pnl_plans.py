"""Fill, position, report and risk queries (purchases as fills, ``orders`` as order intents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookweave.functions.scalars import int_div
from bookweave.operators import pnl as P
from bookweave.operators import risk as R
from bookweave.plans.catalog import query
from bookweave.sources.driver_tables import (
    FILLS_SQL,
    INTENTS_SQL,
    ME_SQL,
    PNL_SQL,
    fills,
    market_events,
    order_intents,
    pnl_stream,
)

ME = f"WITH {ME_SQL} "
FI = f"WITH {FILLS_SQL} "
PN = f"WITH {PNL_SQL} "
IN = f"WITH {INTENTS_SQL} "


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def s6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- order queue -------------------------------------------------------------------------------------

FIFO = """, ev AS (SELECT *, CASE WHEN event_type = 0 THEN 1 WHEN side = 1 THEN -1 ELSE 0 END AS step FROM me WHERE event_type IN (0, 3)),
c AS (SELECT *, sum(step) OVER w AS c, sum(CASE WHEN event_type = 0 THEN 1 ELSE 0 END) OVER w AS sub FROM ev WINDOW w AS (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq)),
h AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq)) AS held FROM c),
q AS (SELECT *, lag(held) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq) AS hb FROM h),
att AS (SELECT f.venue_id, f.seq, f.ts_exchange_ns AS ts_ns, o.seq AS order_id, o.ts_exchange_ns AS order_ts_ns, f.price_fp, o.price_fp AS order_price_fp,
   abs(f.price_fp - o.price_fp) / o.price_fp::DOUBLE * 10000 AS slip
   FROM q f JOIN q o ON f.venue_id = o.venue_id AND o.event_type = 0 AND f.event_type = 3 AND f.hb > 0 AND o.sub = f.sub - f.hb + 1) """


def _queue(spark, d):
    events = market_events(spark, d).withColumnRenamed("ts_exchange_ns", "ts_ns")
    orders = events.filter("event_type = 0").select("venue_id", F.col("seq").alias("order_id"), "ts_ns", "seq", "price_fp")
    hits = events.filter("event_type = 3").select("venue_id", "ts_ns", "seq", "price_fp", (F.col("side") == 1).alias("is_full"))
    cancels = events.filter("event_type = 2").select("venue_id")
    return orders, hits, cancels


@query("fifo_fills", "C4", ME + FIFO + "SELECT venue_id, seq, order_id FROM att")
def _(spark, d):
    orders, hits, _ = _queue(spark, d)
    return P.attribute_fills(orders, hits, ["venue_id"]).select("venue_id", "seq", "order_id")


@query("fill_slippage", "C5", ME + FIFO + "SELECT seq, order_id, round(slip, 6) AS slippage_bp FROM att")
def _(spark, d):
    orders, hits, _ = _queue(spark, d)
    rows = P.attribute_fills(orders, hits, ["venue_id"])
    return rows.select("seq", "order_id", F.round(P.slippage_bp(F.col("price_fp"), F.col("order_price_fp")), 6).alias("slippage_bp"))


@query(
    "execution_stats",
    "D24",
    ME
    + FIFO
    + """, n AS (SELECT venue_id, count(*) FILTER (event_type = 0) AS total_orders, count(*) FILTER (event_type = 3) AS total_fills, count(*) FILTER (event_type = 2) AS total_cancels FROM me GROUP BY 1),
 l AS (SELECT venue_id, sum(ts_ns - order_ts_ns) / 1e6 AS lat, sum(slip) AS slip FROM att GROUP BY 1)
 SELECT venue_id, total_orders, total_fills, total_cancels, round(lat / total_fills, 4) AS avg_fill_latency_ms, round(slip, 6) AS total_slippage_bp FROM n JOIN l USING (venue_id)""",
)
def _(spark, d):
    stats = P.execution_stats(*_queue(spark, d), ["venue_id"])
    return stats.withColumns({"avg_fill_latency_ms": F.round("avg_fill_latency_ms", 4), "total_slippage_bp": F.round("total_slippage_bp", 6)})


@query(
    "cumulative_slippage",
    "E10",
    ME + FIFO + "SELECT seq, round(sum(slip) OVER (PARTITION BY venue_id ORDER BY ts_ns, seq), 6) AS cumulative_slippage_bp FROM att",
)
def _(spark, d):
    orders, hits, _ = _queue(spark, d)
    rows = P.attribute_fills(orders, hits, ["venue_id"]).withColumn("slip", P.slippage_bp(F.col("price_fp"), F.col("order_price_fp")))
    out = R.cumulative(rows, ["venue_id"], P.FILL_ORDER, F.col("slip"), "cumulative_slippage_bp")
    return out.select("seq", *r6("cumulative_slippage_bp"))


# --- positions ---------------------------------------------------------------------------------------

NET = "SELECT symbol_id, seq, CAST(sum(CASE WHEN side = 0 THEN qty_fp ELSE -qty_fp END) OVER (PARTITION BY symbol_id ORDER BY ts_ns, seq) AS BIGINT) AS net_qty_fp FROM fills"


@query("net_quantities", "E5", FI + NET)
def _(spark, d):
    return P.net_quantities(fills(spark, d)).select("symbol_id", "seq", "net_qty_fp")


POS = """, o AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY ts_ns, seq) AS rn FROM fills),
p AS (
  WITH RECURSIVE st AS (
    SELECT symbol_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS HUGEINT) AS net, CAST(0 AS HUGEINT) AS av, CAST(0 AS HUGEINT) AS pnl, CAST(0 AS BIGINT) AS ts FROM (SELECT DISTINCT symbol_id FROM fills)
    UNION ALL
    SELECT symbol_id, rn, net2, CASE WHEN net2 = 0 THEN 0 ELSE av2 END, pnl2, ts FROM (
      SELECT s.symbol_id, o.rn, o.ts_ns AS ts, s.net + g * o.qty_fp AS net2,
        CASE WHEN s.net * g >= 0 THEN CASE WHEN s.net * g + o.qty_fp > 0 THEN (s.av * s.net * g + o.price_fp::HUGEINT * o.qty_fp) // (s.net * g + o.qty_fp) ELSE s.av END
             WHEN o.qty_fp > -(s.net * g) THEN o.price_fp ELSE s.av END AS av2,
        CASE WHEN s.net * g >= 0 THEN s.pnl ELSE s.pnl + ((s.av - o.price_fp) * g * least(o.qty_fp, -(s.net * g))) // 1000000 END AS pnl2
      FROM st s JOIN (SELECT *, CASE WHEN side = 0 THEN 1 ELSE -1 END AS g FROM o) o ON o.symbol_id = s.symbol_id AND o.rn = s.rn + 1)
  ) SELECT * FROM st
), final AS (SELECT symbol_id, CAST(net AS BIGINT) AS net_qty_fp, CAST(av AS BIGINT) AS avg_entry_price_fp, CAST(pnl AS BIGINT) AS realized_pnl_fp, ts AS last_fill_ts_ns
  FROM p QUALIFY rn = max(rn) OVER (PARTITION BY symbol_id)) """


@query("positions", "E12", FI.replace("WITH", "WITH RECURSIVE", 1) + POS + "SELECT * FROM final")
def _(spark, d):
    return P.positions(fills(spark, d))


@query(
    "position_history",
    "E12",
    FI.replace("WITH", "WITH RECURSIVE", 1)
    + POS
    + "SELECT symbol_id, ts AS ts_ns, CAST(net AS BIGINT) AS net_qty_fp, CAST(av AS BIGINT) AS avg_entry_price_fp, CAST(pnl AS BIGINT) AS realized_pnl_fp FROM p WHERE rn > 0",
)
def _(spark, d):
    return P.position_history(fills(spark, d))[0].drop("seq")


@query(
    "position_notional",
    "C11",
    FI
    + """, n AS (SELECT symbol_id, sum(CASE WHEN side = 0 THEN qty_fp ELSE -qty_fp END) AS net FROM fills GROUP BY 1),
 m AS (SELECT symbol_id, avg(price_fp / 1e8) AS mid FROM me WHERE event_type = 4 AND symbol_id < 12 GROUP BY 1)
 SELECT round(sum(abs(net) / 1e6 * coalesce(mid, 0)), 4) AS total_notional FROM n LEFT JOIN m USING (symbol_id)""",
)
def _(spark, d):
    net = fills(spark, d).groupBy("symbol_id").agg(F.sum(P.signed_qty()).alias("net_qty_fp"))
    mids = market_events(spark, d).filter("event_type = 4 AND symbol_id < 12").groupBy("symbol_id").agg(F.avg(F.col("price_fp") / F.lit(1e8)).alias("mid"))
    return P.total_notional(net, mids).select(F.round("total_notional", 4).alias("total_notional"))


# --- round trips and reports ---------------------------------------------------------------------------

TRIPS = (
    FI
    + """, o AS (SELECT *, row_number() OVER w AS rn, lag(price_fp) OVER w AS ep, lag(ts_ns) OVER w AS et FROM fills WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_ns, seq)),
 trips AS (SELECT symbol_id, ep / 1e6 AS entry_price, price_fp / 1e6 AS exit_price, qty_fp / 1e6 AS quantity, (price_fp / 1e6 - ep / 1e6) * (qty_fp / 1e6) AS pnl, et AS entry_ts_ns, ts_ns AS exit_ts_ns, seq FROM o WHERE rn % 2 = 0) """
)


def trips(spark, d):
    return P.round_trips(fills(spark, d), 1_000_000)


@query(
    "round_trips",
    "E11",
    TRIPS + f"SELECT symbol_id, CASE WHEN pnl >= 0 THEN 'buy' ELSE 'sell' END AS side, {s6('entry_price', 'exit_price', 'quantity', 'pnl')}, entry_ts_ns, exit_ts_ns FROM trips",
)
def _(spark, d):
    return trips(spark, d).select("symbol_id", "side", *r6("entry_price", "exit_price", "quantity", "pnl"), "entry_ts_ns", "exit_ts_ns")


AGG = {
    "total_pnl": "sum(pnl)",
    "total_trades": "count(*)",
    "win_rate": "count(*) FILTER (pnl > 0) / count(*)::DOUBLE",
    "avg_trade_return": "avg(pnl)",
    "profit_factor": "CASE WHEN abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl <= 0)) WHEN sum(pnl) > 0 THEN 'Infinity'::DOUBLE ELSE 0 END",
    "sharpe_ratio": "CASE WHEN count(*) >= 2 AND stddev_samp(pnl) > 0 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END",
    "sortino_ratio": "CASE WHEN count(*) < 2 THEN 0 WHEN count(*) FILTER (pnl < 0) = 0 THEN CASE WHEN avg(pnl) > 0 THEN 'Infinity'::DOUBLE ELSE 0 END ELSE avg(pnl) / sqrt(avg(pnl * pnl) FILTER (pnl < 0)) * sqrt(252) END",
}


def agg_sql(*names):
    return ", ".join(f"round({AGG[n]}, 6) AS {n}" if n != "total_trades" else f"{AGG[n]} AS {n}" for n in names)


def agg_df(spark, d, *names, keys=()):
    rows = P.report(trips(spark, d), list(keys), *names)
    return rows.select(*keys, *[c if c == "total_trades" else F.round(c, 6).alias(c) for c in names])


@query("backtest_totals", "D18", TRIPS + f"SELECT {agg_sql('total_pnl', 'total_trades', 'win_rate', 'avg_trade_return')} FROM trips")
def _(spark, d):
    return agg_df(spark, d, "total_pnl", "total_trades", "win_rate", "avg_trade_return")


@query("profit_factor", "D19", TRIPS + f"SELECT symbol_id, {agg_sql('profit_factor')} FROM trips GROUP BY 1")
def _(spark, d):
    return agg_df(spark, d, "profit_factor", keys=["symbol_id"])


@query("sharpe_ratio", "D20", TRIPS + f"SELECT symbol_id, {agg_sql('sharpe_ratio')} FROM trips GROUP BY 1")
def _(spark, d):
    return agg_df(spark, d, "sharpe_ratio", keys=["symbol_id"])


@query("sortino_ratio", "D21", TRIPS + f"SELECT symbol_id, {agg_sql('sortino_ratio')} FROM trips GROUP BY 1")
def _(spark, d):
    return agg_df(spark, d, "sortino_ratio", keys=["symbol_id"])


DD = """, cu AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol_id ORDER BY exit_ts_ns, seq) AS cum FROM trips),
 pk AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol_id ORDER BY exit_ts_ns, seq)) AS peak FROM cu),
 dd AS (SELECT symbol_id, max(CASE WHEN peak > 1e-12 THEN (peak - cum) / peak ELSE 0 END) * 100 AS max_drawdown_pct FROM pk GROUP BY 1) """


@query("max_drawdown", "E6", TRIPS + DD + f"SELECT symbol_id, {s6('max_drawdown_pct')} FROM dd")
def _(spark, d):
    return P.max_drawdown(trips(spark, d), ["symbol_id"], ["exit_ts_ns", "seq"]).select("symbol_id", *r6("max_drawdown_pct"))


GATE = ", gt AS (SELECT symbol_id, avg(CASE WHEN qty_fp > 2000000000 THEN 1.0 ELSE 0.0 END) AS up FROM me GROUP BY 1) "


def gate_rows(spark, d):
    return market_events(spark, d).select("symbol_id", (F.col("qty_fp") > 2_000_000_000).alias("allow_act"))


@query("gate_uptime", "D22", ME + GATE + "SELECT symbol_id, round(up, 6) AS coherence_uptime, round(1 - up, 6) AS gate_rejection_rate FROM gt")
def _(spark, d):
    return P.gate_uptime(gate_rows(spark, d), ["symbol_id"]).select("symbol_id", *r6("coherence_uptime", "gate_rejection_rate"))


@query(
    "backtest_report",
    "D23",
    TRIPS
    + DD
    + GATE
    + f""", ag AS (SELECT symbol_id, {agg_sql(*AGG)} FROM trips GROUP BY 1)
 SELECT ag.*, {s6('max_drawdown_pct')}, round(up, 6) AS coherence_uptime, round(1 - up, 6) AS gate_rejection_rate FROM ag JOIN dd USING (symbol_id) JOIN gt USING (symbol_id)""",
)
def _(spark, d):
    rows = P.full_report(trips(spark, d), gate_rows(spark, d), ["symbol_id"], ["exit_ts_ns", "seq"])
    return rows.select("symbol_id", *[c if c == "total_trades" else F.round(c, 6).alias(c) for c in rows.columns if c != "symbol_id"])


# --- drawdown ------------------------------------------------------------------------------------------

DRAW = """, x AS (SELECT *, ts_ns // 86400000000000 AS day, (ts_ns // 86400000000000 + 3) // 7 AS week FROM pnl),
 c AS (SELECT *, sum(pnl_usd) OVER (PARTITION BY day ORDER BY ts_ns, seq) AS dc, sum(pnl_usd) OVER (PARTITION BY week ORDER BY ts_ns, seq) AS wc FROM x),
 p AS (SELECT *, greatest(0, max(dc) OVER (PARTITION BY day ORDER BY ts_ns, seq)) - dc AS dfall, greatest(0, max(wc) OVER (PARTITION BY week ORDER BY ts_ns, seq)) - wc AS wfall FROM c),
 r AS (SELECT *, dfall / {base} * 100 AS dpct, wfall / {base} * 100 AS wpct FROM p),
 f AS (SELECT min(ts_ns) AS first_at FROM r WHERE dpct >= {d} OR wpct >= {w})
 SELECT seq, round(dpct, 6) AS daily_drawdown_pct, round(wpct, 6) AS weekly_drawdown_pct,
  CASE WHEN dpct >= {d} THEN printf('Daily drawdown %.2f%% >= {d}%% threshold', dpct) WHEN wpct >= {w} THEN printf('Weekly drawdown %.2f%% >= {w}%% threshold', wpct) END AS break_reason
 FROM r WHERE ts_ns <= coalesce((SELECT first_at FROM f), ts_ns)"""


@query("drawdown_monitor", "E7", PN + DRAW.format(base="6500.0", d="5", w="8"))
def _(spark, d):
    rows = R.drawdown_monitor(pnl_stream(spark, d), 5, 8, 6500.0)
    return rows.select("seq", *r6("daily_drawdown_pct", "weekly_drawdown_pct"), "break_reason")


@query(
    "session_drawdown",
    "E8",
    PN
    + """, c AS (SELECT *, sum(pnl_usd) OVER (PARTITION BY symbol_id ORDER BY ts_ns, seq) AS cum FROM pnl),
 p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol_id ORDER BY ts_ns, seq)) AS peak FROM c),
 q AS (SELECT *, CASE WHEN peak > 1e-9 THEN (peak - cum) / peak * 100 WHEN cum < -1e-9 THEN abs(cum) / 999983 * 100 END AS dd FROM p)
 SELECT seq, round(coalesce(last_value(dd IGNORE NULLS) OVER (PARTITION BY symbol_id ORDER BY ts_ns, seq), 0), 6) AS session_drawdown_pct FROM q""",
)
def _(spark, d):
    rows = R.session_drawdown(pnl_stream(spark, d), ["symbol_id"], 999_983)
    return rows.select("seq", F.round("session_drawdown_pct", 6).alias("session_drawdown_pct"))


# --- order intents and limits ----------------------------------------------------------------------------


@query(
    "order_notional",
    "B31",
    IN + "SELECT order_id, round((CASE WHEN price_fp = 0 THEN 1.0 ELSE price_fp / 1e6 END) * (qty_fp / 1e6), 4) AS notional FROM intents",
)
def _(spark, d):
    rows = order_intents(spark, d)
    return rows.select("order_id", F.round(R.order_notional(F.col("price_fp"), F.col("qty_fp")), 4).alias("notional"))


@query(
    "symbol_notional",
    "D26",
    IN + "SELECT symbol_id, round(sum(price_fp / 1e6 * (qty_fp / 1e6)), 2) AS notional FROM intents GROUP BY 1",
)
def _(spark, d):
    rows = order_intents(spark, d).withColumn("notional", R.order_notional(F.col("price_fp"), F.col("qty_fp")))
    return rows.groupBy("symbol_id").agg(F.round(F.sum("notional"), 2).alias("notional"))


@query(
    "running_notional",
    "D26",
    IN
    + """SELECT order_id, round(coalesce(sum(n) OVER (ORDER BY ts_ns, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS total_notional,
 round(coalesce(sum(n) OVER (PARTITION BY symbol_id ORDER BY ts_ns, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS symbol_notional
 FROM (SELECT *, price_fp / 1e6 * (qty_fp / 1e6) AS n FROM intents)""",
)
def _(spark, d):
    rows = R.with_running_notional(order_intents(spark, d))
    return rows.select("order_id", F.round("total_notional", 2).alias("total_notional"), F.round("symbol_notional", 2).alias("symbol_notional"))


@query(
    "rolling_rates",
    "E9",
    ME
    + """SELECT venue_id, seq, count(*) FILTER (event_type = 0) OVER w AS order_rate, count(*) FILTER (event_type = 2) OVER w AS cancel_rate FROM me
 WINDOW w AS (PARTITION BY venue_id ORDER BY ts_exchange_ns RANGE BETWEEN 3600000000000 PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    """An hour instead of the default second: the table has one event per four minutes."""
    events = market_events(spark, d).select("venue_id", "ts_exchange_ns", "seq", "event_type")
    is_order, is_cancel = F.col("event_type") == 0, F.col("event_type") == 2
    out = R.rates(events, ["venue_id"], "ts_exchange_ns", "seq", 3_600_000_000_000, order_rate=is_order, cancel_rate=is_cancel)
    return out.select("venue_id", "seq", "order_rate", "cancel_rate")


LIMITS = R.RiskLimits(
    max_notional=2_000_000_000, max_symbol_notional=2_000_000, max_order_rate=9, max_cancel_rate=3, max_slippage_bp=4000, max_drawdown_pct=60
)


@query(
    "risk_check",
    "B32",
    IN
    + """, x AS (SELECT *, price_fp / 1e6 * (qty_fp / 1e6) AS notional, (price_fp // 10000 % 100) / 100.0::DOUBLE AS slip FROM intents),
 r AS (SELECT *, coalesce(sum(notional) OVER g, 0) AS tn, coalesce(sum(notional) OVER s, 0) AS sn, row_number() OVER dy - 1 AS orate,
   coalesce(sum(CASE WHEN qty_fp = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ts_ns ORDER BY order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS crate,
   coalesce(sum(slip) OVER g, 0) AS sl, (price_fp // 10000 % 7000) / 100.0::DOUBLE AS dd
   FROM x WINDOW g AS (ORDER BY ts_ns, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   s AS (PARTITION BY symbol_id ORDER BY ts_ns, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), dy AS (PARTITION BY ts_ns ORDER BY order_id)),
 v AS (SELECT order_id, list_filter([
   CASE WHEN tn + notional > 2000000000 THEN printf('Total notional %.2f > max 2000000000', tn + notional) END,
   CASE WHEN sn + notional > 2000000 THEN printf('Symbol %d notional %.2f > max 2000000', symbol_id, sn + notional) END,
   CASE WHEN orate >= 9 THEN printf('Order rate %d/s >= max 9/s', orate) END,
   CASE WHEN crate >= 3 THEN printf('Cancel rate %d/s >= max 3/s', crate) END,
   CASE WHEN sl > 4000 THEN printf('Cumulative slippage %.2fbp > max 4000bp', sl) END,
   CASE WHEN dd > 60 THEN printf('Session drawdown %.2f%% > max 60%%', dd) END,
   CASE WHEN orate >= 7.2 THEN printf('Order rate %d/s >= throttle threshold 7/s (80%% of max)', orate) END], lambda z: z IS NOT NULL) AS violations FROM r)
 SELECT order_id, len(violations) = 0 AS allowed, array_to_string(violations, '; ') AS violations FROM v""",
)
def _(spark, d):
    """Slippage and drawdown are arithmetic of the price, so SQL can repeat them."""
    cents = int_div(F.col("price_fp"), 10_000)
    rows = R.with_running_notional(order_intents(spark, d)).withColumns(
        {"slip": F.pmod(cents, F.lit(100)) / 100, "drawdown_pct": F.pmod(cents, F.lit(7000)) / 100}
    )
    rows = R.cumulative(rows, [], ["ts_ns", "order_id"], F.col("slip"), "slippage_bp")
    rows = rows.withColumn("slippage_bp", F.col("slippage_bp") - F.col("slip"))
    is_cancel = F.col("qty_fp") == 0
    rows = R.rates(rows, [], "ts_ns", "order_id", 1_000_000_000, order_rate=F.lit(True), cancel_rate=is_cancel)
    # the counts include the order itself; the check looks at what was there before it
    rows = rows.withColumns({"order_rate": F.col("order_rate") - 1, "cancel_rate": F.col("cancel_rate") - is_cancel.cast("bigint")})
    out = R.risk_check(rows, LIMITS)
    return out.select("order_id", "allowed", F.array_join("violations", "; ").alias("violations"))


# --- breakers ----------------------------------------------------------------------------------------------

ERR = """, e AS (SELECT *, qty_fp > 5000000000 AS ok FROM me),
 i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq) AS isl FROM e),
 n AS (SELECT *, CAST(sum((NOT ok)::INT) OVER (PARTITION BY venue_id, isl ORDER BY ts_exchange_ns, seq) AS BIGINT) AS n FROM i) """


@query(
    "error_breaker",
    "E22",
    ME + ERR + "SELECT seq, n AS consecutive_errors, NOT ok AND n >= 4 AS triggered, CASE WHEN NOT ok AND n >= 4 THEN n || ' consecutive errors >= max 4' END AS reason FROM n",
)
def _(spark, d):
    rows = market_events(spark, d).withColumn("ok", F.col("qty_fp") > 5_000_000_000)
    out = R.error_breaker(rows, ["venue_id"], ["ts_exchange_ns", "seq"], 4)
    return out.select("seq", "consecutive_errors", "triggered", "reason")


LATCH = """, y AS (SELECT *, CASE WHEN qty_fp = 100000000 THEN 'drawdown ' || seq WHEN qty_fp = 200000000 THEN printf('Venue %d is unhealthy', venue_id) WHEN qty_fp = 300000000 THEN printf('Venue %d is halted', venue_id) END AS why, qty_fp > 9700000000 AS rs FROM me),
 ep AS (SELECT *, sum(rs::INT) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq) AS epoch FROM y),
 la AS (SELECT *, first_value(why IGNORE NULLS) OVER (PARTITION BY venue_id, epoch ORDER BY ts_exchange_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fr FROM ep) """


def _latched(spark, d):
    rows = market_events(spark, d)
    qty = F.col("qty_fp")
    why = R.breaker_reason(
        F.when(qty == 100_000_000, F.concat(F.lit("drawdown "), "seq")), F.col("venue_id"), qty != 200_000_000, qty == 300_000_000
    )
    return R.latch(rows, ["venue_id"], ["ts_exchange_ns", "seq"], why, qty > 9_700_000_000)


@query("breaker_latch", "E23", ME + LATCH + "SELECT seq, fr IS NOT NULL AS active, fr AS active_reason FROM la")
def _(spark, d):
    return _latched(spark, d).select("seq", "active", "active_reason")


@query(
    "kill_switch_holds",
    "E24",
    ME + LATCH + "SELECT active_reason, count(*) AS n_held FROM (SELECT fr AS active_reason FROM la WHERE fr IS NOT NULL AND event_type = 0) GROUP BY 1",
)
def _(spark, d):
    """Control events and decisions share one ordered table, so the switch state at a decision is the
    latch itself: no range join."""
    held = _latched(spark, d).filter("active AND event_type = 0")
    return held.groupBy("active_reason").agg(F.count(F.lit(1)).alias("n_held"))


COOL = """, al AS (SELECT event_type, ts_exchange_ns AS ts, seq, row_number() OVER (PARTITION BY event_type ORDER BY ts_exchange_ns, seq) AS rn FROM me),
 snt AS (WITH RECURSIVE g AS (
   SELECT event_type, ts, seq FROM al WHERE rn = 1
   UNION ALL
   SELECT event_type, ts, seq FROM (SELECT a.event_type, a.ts, a.seq, row_number() OVER (PARTITION BY a.event_type ORDER BY a.ts, a.seq) AS k FROM g JOIN al a ON a.event_type = g.event_type AND a.ts >= g.ts + 21600000000000) WHERE k = 1)
   SELECT * FROM g) """


@query(
    "alert_cooldown",
    "E25",
    ME.replace("WITH", "WITH RECURSIVE", 1) + COOL + "SELECT al.event_type AS alert_type, al.seq, snt.seq IS NOT NULL AS sent FROM al LEFT JOIN snt ON al.seq = snt.seq",
)
def _(spark, d):
    rows = market_events(spark, d).select(F.col("event_type").alias("alert_type"), F.col("ts_exchange_ns").alias("ts_ns"), "seq")
    return R.alert_cooldown(rows, 21_600_000_000_000).select("alert_type", "seq", "sent")


@query(
    "alert_rows",
    "E26",
    ME
    + ERR
    + """SELECT 'circuit_breaker' AS alert_type, 'critical' AS severity, 'Circuit breaker triggered: ' || n || ' consecutive errors >= max 4' AS message, ts_exchange_ns AS ts_ns, seq FROM n WHERE NOT ok AND n >= 4
 UNION ALL SELECT 'kill_switch', 'critical', 'Kill switch activated: quantity 1', ts_exchange_ns, seq FROM me WHERE qty_fp = 100000000""",
)
def _(spark, d):
    events = market_events(spark, d).withColumn("ts_ns", F.col("ts_exchange_ns"))
    rows = events.withColumn("ok", F.col("qty_fp") > 5_000_000_000)
    trips_ = R.error_breaker(rows, ["venue_id"], ["ts_exchange_ns", "seq"], 4).filter("triggered")
    kill = events.filter("qty_fp = 100000000").withColumn("reason", F.lit("quantity 1"))
    return R.alert_rows(trips_, kill)


@query(
    "cusum_alarms",
    "E30",
    ME
    + """, m AS (SELECT venue_id, seq, ts_exchange_ns, price_fp / 1e8 - 100 AS x, avg(price_fp / 1e8 - 100) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS mu FROM me),
 c AS (SELECT *, sum(x - coalesce(mu, x) - 0.0100037123::DOUBLE) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq) AS c FROM m),
 s AS (SELECT *, c - least(0, min(c) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq)) AS s FROM c)
 SELECT seq, round(s, 6) AS cusum, s > 0.5 AS alarm FROM s""",
)
def _(spark, d):
    """Mean over the 100 rows before (the default drift window is 1000), k 0.0100037123 (no rounding ties), h 0.5."""
    rows = market_events(spark, d).select("venue_id", "seq", "ts_exchange_ns", (F.col("price_fp") / F.lit(1e8) - 100).alias("x"))
    order = ["ts_exchange_ns", "seq"]
    rows = R.trailing_mean(rows, ["venue_id"], order, F.col("x"), 100, "mu")
    out = R.cusum(rows, ["venue_id"], order, F.col("x"), F.coalesce("mu", "x"), 0.0100037123, 0.5)
    return out.select("seq", F.round("cusum", 6).alias("cusum"), "alarm")
