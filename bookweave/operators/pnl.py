"""Fills, positions, round trips and backtest reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import int_div
from bookweave.operators.ordered import (
    count_of,
    fold_in_rounds,
    independent_bundles,
    lag_of,
    reflected_sum,
    running,
    sum_of,
    uncombined,
)
from bookweave.operators.topk import latest_per_key
from bookweave.schemas import INGEST_SCALE, RISK_SCALE
from bookweave.session import cut_lineage

FILL_ORDER = ["ts_ns", "seq"]


def attribute_fills(orders: DataFrame, fills: DataFrame, keys: list[str]) -> DataFrame:
    """Each fill with the earliest-submitted order still held; only a full fill releases an order,
    and a fill that meets no held order is skipped.

    The number of held orders is a sum reflected at zero (+1 per order, -1 per full fill), so orders
    released so far = orders submitted - held, which gives the rank of the order a fill belongs to.
    ``orders``: keys, order_id, ts_ns, seq, ...; ``fills``: keys, ts_ns, seq, is_full, ...
    """
    own = orders.select(*keys, "ts_ns", "seq", F.lit(0).alias("_kind"), F.lit(False).alias("is_full"), F.struct("*").alias("_order"))
    hits = fills.select(*keys, "ts_ns", "seq", F.lit(1).alias("_kind"), "is_full", F.struct("*").alias("_fill"))
    both = own.unionByName(hits, allowMissingColumns=True)
    is_order = F.col("_kind") == 0
    step = F.when(is_order, 1).when(F.col("is_full"), -1).otherwise(0).cast("bigint")
    order = ["ts_ns", "seq", "_kind"]
    queue = reflected_sum(both, keys, order, step, "_held")
    queue = running(queue, keys, order, _submitted=count_of(is_order), _before=lag_of(F.col("_held")))
    ranked = queue.withColumn("_rank", F.when(is_order, F.col("_submitted")).otherwise(
        # released before this fill = submitted - held before it
        F.col("_submitted") - F.coalesce(F.col("_before.v"), F.lit(0)) + 1
    ))
    ranked = cut_lineage(ranked.select(*keys, "_kind", "_rank", "_fill", "_order", "_before"))
    left = ranked.filter((F.col("_kind") == 1) & (F.col("_before.v") > 0)).select(*keys, "_rank", "_fill")
    right = ranked.filter(is_order).select(*keys, "_rank", "_order")
    return left.join(right, [*keys, "_rank"]).select(
        *[F.col("_fill")[c].alias(c) for c in fills.columns],
        *[F.col("_order")[c].alias(f"order_{c}" if not c.startswith("order_") else c) for c in orders.columns if c not in keys],
    )


def slippage_bp(fill_price: Column, intended: Column) -> Column:
    """Distance of the fill from the intended price in bp, only when a price was intended."""
    return F.when(
        intended > 0, F.abs(fill_price - intended).cast("double") / intended.cast("double") * 10_000
    )


def execution_stats(orders: DataFrame, fills: DataFrame, cancels: DataFrame, keys: list[str]) -> DataFrame:
    """Orders, fills, cancels, mean fill latency and total slippage per key."""
    matched = attribute_fills(orders, fills, keys)
    # a queue that grows gives latencies of days, whose sum in ns is beyond 64 bits after some thousand fills
    latency = (F.col("ts_ns") - F.col("order_ts_ns")).cast("decimal(20,0)")
    per_match = matched.groupBy(*keys).agg(
        (F.sum(latency).cast("double") / 1_000_000).alias("latency_sum"),
        F.coalesce(F.sum(slippage_bp(F.col("price_fp"), F.col("order_price_fp"))), F.lit(0.0)).alias("total_slippage_bp"),
    )
    counts = (
        orders.select(*keys, F.lit("o").alias("w"))
        .unionByName(fills.select(*keys, F.lit("f").alias("w")))
        .unionByName(cancels.select(*keys, F.lit("c").alias("w")))
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("w") == "o").alias("total_orders"),
            F.count_if(F.col("w") == "f").alias("total_fills"),
            F.count_if(F.col("w") == "c").alias("total_cancels"),
        )
    )
    return counts.join(per_match, keys, "left").select(
        *keys,
        "total_orders",
        "total_fills",
        "total_cancels",
        F.when(F.col("total_fills") > 0, F.coalesce("latency_sum", F.lit(0.0)) / F.col("total_fills")).otherwise(F.lit(0.0)).alias("avg_fill_latency_ms"),
        F.coalesce("total_slippage_bp", F.lit(0.0)).alias("total_slippage_bp"),
    )


def signed_qty() -> Column:
    return F.when(F.col("side") == 0, F.col("qty_fp")).otherwise(-F.col("qty_fp"))


def net_quantities(fills: DataFrame) -> DataFrame:
    return running(fills, ["symbol_id"], FILL_ORDER, net_qty_fp=sum_of(signed_qty())).drop("_chunk")


def _truncated(numerator: int, denominator: int) -> int:
    quotient = abs(numerator) // abs(denominator)
    return quotient if (numerator >= 0) == (denominator > 0) else -quotient


def apply_fill(net: int, avg: int, pnl: int, side: int, price: int, qty: int, scale: int) -> tuple[int, int, int]:
    """One fill on (net, average entry, realised pnl), in truncating integer arithmetic."""
    sign = 1 if side == 0 else -1
    held = net * sign  # position seen in the direction of the fill
    if held >= 0:
        if held + qty > 0:
            avg = _truncated(avg * held + price * qty, held + qty)
    else:
        closed = min(qty, -held)
        pnl += _truncated((avg - price) * sign * closed, scale)
        if qty > closed:
            avg = price
    net += sign * qty
    return net, (avg if net else 0), pnl


POSITION = ["net_qty_fp", "avg_entry_price_fp", "realized_pnl_fp", "last_fill_ts_ns"]


def position_step(scale: int = RISK_SCALE):
    def step(rows, before):
        net, avg, pnl, last = (int(before[c]) for c in POSITION) if before else (0, 0, 0, 0)
        out = []
        for side, price, qty, ts, seq, part in zip(rows.side, rows.price_fp, rows.qty_fp, rows.ts_ns, rows.seq, rows.part):
            net, avg, pnl = apply_fill(net, avg, pnl, int(side), int(price), int(qty), scale)
            last = int(ts)
            out.append((last, int(seq), int(part), net, avg, pnl))
        return out, dict(zip(POSITION, (net, avg, pnl, last)))

    return step


def position_history(fills: DataFrame, rows_per_round: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(position after every fill, final positions).

    Average entry needs the exact truncated result of the fill before, so it is a sequential fold; but what stands
    before a flat position does not matter to it. So the running net quantity tells where a position is flat or turns
    (a fill that turns it counts as two, one that closes and one that opens), a symbol is cut there into bundles that
    are folded side by side, and the profit of earlier bundles is added. Only a position that is never flat for
    more than ``rows_per_round`` fills is folded in rounds."""
    keys, order = ["symbol_id"], [*FILL_ORDER, "part"]
    slim = fills.select("symbol_id", "side", "price_fp", "qty_fp", "ts_ns", "seq")
    signed = F.when(F.col("side") == 0, F.col("qty_fp")).otherwise(-F.col("qty_fp"))
    netted = uncombined(running(slim, keys, FILL_ORDER, _net=sum_of(signed)))
    before = F.col("_net") - signed
    turns = F.signum(before) * F.signum("_net") < 0
    # part 0 is the closing half of a fill that turns the position
    part = lambda number, qty, opens: F.struct(F.lit(number).alias("part"), qty.alias("qty_fp"), opens.alias("opens"))
    halves = F.array(part(0, F.abs(before), F.lit(False)), part(1, F.abs("_net"), F.lit(True)))
    parts = F.when(turns, halves).otherwise(F.array(part(1, F.col("qty_fp"), before == 0)))
    rows = netted.select(*[c for c in netted.columns if c not in ("_net", "qty_fp")], F.inline(parts))
    rows = independent_bundles(rows, keys, order, F.col("opens"), rows_per_round).drop("opens")
    history, final = fold_in_rounds(
        rows, [*keys, "_bundle"], order, position_step(), POSITION,
        "ts_ns bigint, seq bigint, part int, net_qty_fp bigint, avg_entry_price_fp bigint, realized_pnl_fp bigint",
        rows_per_round,
    )
    final = cut_lineage(final.select(*keys, "_bundle", *[F.col(c).cast("bigint").alias(c) for c in POSITION]))
    gained = running(final, keys, ["_bundle"], _gained=sum_of(F.col("realized_pnl_fp"), "previous"))
    earlier = gained.select(*keys, "_bundle", F.coalesce("_gained", F.lit(0)).alias("_gained"))
    pnl = (F.col("realized_pnl_fp") + F.col("_gained")).cast("bigint").alias("realized_pnl_fp")
    columns = [c for c in history.columns if c not in ("_bundle", "part")]
    history = history.filter("part = 1").join(earlier, [*keys, "_bundle"]).select(*[pnl if c == "realized_pnl_fp" else c for c in columns])
    last = latest_per_key(final.join(earlier, [*keys, "_bundle"]), keys, ["_bundle"])
    return history, last.select("symbol_id", *[pnl if c == "realized_pnl_fp" else c for c in POSITION])


def positions(fills: DataFrame, rows_per_round: int = 1_000_000) -> DataFrame:
    return position_history(fills, rows_per_round)[1]


def total_notional(positions: DataFrame, mids: DataFrame) -> DataFrame:
    """Sum of |net| x mid; a symbol without a mid counts as 0."""
    joined = positions.join(mids, "symbol_id", "left")
    value = F.abs("net_qty_fp") / F.lit(float(RISK_SCALE)) * F.coalesce("mid", F.lit(0.0))
    return joined.agg(F.sum(value).alias("total_notional"))


def round_trips(fills: DataFrame, scale: int = INGEST_SCALE) -> DataFrame:
    """Fills of a symbol alternate entry and exit; every second fill closes the one before it."""
    entry = F.struct("price_fp", "ts_ns")
    rows = running(fills, ["symbol_id"], FILL_ORDER, rn=count_of(), entry=lag_of(entry))
    closes = rows.filter(F.col("rn") % 2 == 0)
    one = F.lit(float(scale))
    entry_price = F.col("entry.v.price_fp") / one
    exit_price = F.col("price_fp") / one
    quantity = F.col("qty_fp") / one
    pnl = (exit_price - entry_price) * quantity
    return closes.select(
        "symbol_id",
        F.when(pnl >= 0, "buy").otherwise("sell").alias("side"),
        entry_price.alias("entry_price"),
        exit_price.alias("exit_price"),
        quantity.alias("quantity"),
        pnl.alias("pnl"),
        F.col("entry.v.ts_ns").alias("entry_ts_ns"),
        F.col("ts_ns").alias("exit_ts_ns"),
        F.col("seq"),
    )


# --- reports ---------------------------------------------------------------------------------------

YEAR = math.sqrt(252)
INF = float("inf")


def report_columns() -> dict[str, Column]:
    """Report metrics as aggregates over a ``pnl`` column (drawdown apart, it needs an order)."""
    pnl = F.col("pnl")
    n = F.count(pnl)
    gain = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(pnl <= 0, pnl)), F.lit(0.0)))
    mean, std = F.avg(pnl), F.stddev_samp(pnl)
    downside = F.sqrt(F.avg(F.when(pnl < 0, pnl * pnl)))
    return {
        "total_pnl": F.coalesce(F.sum(pnl), F.lit(0.0)),
        "total_trades": n,
        "win_rate": F.when(n > 0, F.count_if(pnl > 0) / n).otherwise(F.lit(0.0)),
        "avg_trade_return": F.coalesce(mean, F.lit(0.0)),
        "profit_factor": F.when(loss > 0, gain / loss).when(gain > 0, F.lit(INF)).otherwise(F.lit(0.0)),
        "sharpe_ratio": F.when((n >= 2) & (std > 0), F.try_divide(mean, std) * YEAR).otherwise(F.lit(0.0)),
        "sortino_ratio": F.when(n < 2, F.lit(0.0))
        .when(downside.isNull(), F.when(mean > 0, F.lit(INF)).otherwise(F.lit(0.0)))
        .otherwise(F.try_divide(mean, downside) * YEAR),
    }


def report(trades: DataFrame, keys: list[str], *names: str) -> DataFrame:
    wanted = {n: c for n, c in report_columns().items() if not names or n in names}
    aggregated = [c.alias(n) for n, c in wanted.items()]
    return trades.groupBy(*keys).agg(*aggregated) if keys else trades.agg(*aggregated)


def max_drawdown(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Largest fall from the running peak (which starts at 0) in percent of the peak."""
    rows = reflected_sum(trades, keys, order, -F.col("pnl"), "_fall", "_neg")
    peak = F.col("_fall") - F.col("_neg")  # peak - cum = fall, cum = -neg
    fall = F.when(peak > 1e-12, F.col("_fall") / peak).otherwise(F.lit(0.0))
    result = F.coalesce(F.max(fall) * 100, F.lit(0.0)).alias("max_drawdown_pct")
    return rows.groupBy(*keys).agg(result) if keys else rows.agg(result)


def gate_uptime(decisions: DataFrame, keys: list[str]) -> DataFrame:
    allowed = F.avg(F.col("allow_act").cast("double"))
    columns = [
        F.coalesce(allowed, F.lit(1.0)).alias("coherence_uptime"),
        F.coalesce(1 - allowed, F.lit(0.0)).alias("gate_rejection_rate"),
    ]
    return decisions.groupBy(*keys).agg(*columns) if keys else decisions.agg(*columns)


def full_report(trades: DataFrame, decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All ten metrics per key."""
    return (
        report(trades, keys)
        .join(max_drawdown(trades, keys, order), keys)
        .join(gate_uptime(decisions, keys), keys, "left")
        .fillna({"coherence_uptime": 1.0, "gate_rejection_rate": 0.0})
    )
