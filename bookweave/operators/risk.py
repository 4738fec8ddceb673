"""Drawdown monitors, rate windows, risk limits, breakers and latches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import floor_div, int_div
from bookweave.operators.ordered import (
    count_of,
    fold_in_rounds,
    independent_bundles,
    lag_of,
    last_of,
    max_of,
    reflected_sum,
    rolling_counts,
    running,
    sum_of,
    uncombined,
)
from bookweave.schemas import DAY_NS, RISK_SCALE

PNL_ORDER = ["ts_ns", "seq"]


def day_number(ts: Column) -> Column:
    return int_div(ts, DAY_NS)


def iso_week_number(ts: Column) -> Column:
    """Whole weeks from Monday to Sunday, numbered from the epoch (day 0 was a Thursday)."""
    return floor_div(day_number(ts) + 3, 7)


def drawdown_monitor(
    pnl: DataFrame, daily_pct: float, weekly_pct: float, base_capital: float
) -> DataFrame:
    """Daily and weekly fall from the peak in percent of the base capital, up to the first breach.

    The fall from a peak that starts at 0 is a sum reflected at 0 of the negated pnl. Rows after the
    first breach are frozen away; the breach row carries the reason (daily is tested first).
    """
    rows = pnl.withColumns({"day": day_number(F.col("ts_ns")), "week": iso_week_number(F.col("ts_ns"))})
    loss = -F.col("pnl_usd")
    rows = reflected_sum(rows, ["day"], PNL_ORDER, loss, "_d")
    rows = reflected_sum(rows, ["week"], PNL_ORDER, loss, "_w")
    rows = rows.withColumns(
        {
            "daily_drawdown_pct": F.col("_d") / base_capital * 100,
            "weekly_drawdown_pct": F.col("_w") / base_capital * 100,
        }
    ).drop("_d", "_w", "_chunk")
    daily, weekly = F.col("daily_drawdown_pct"), F.col("weekly_drawdown_pct")
    reason = F.when(
        daily >= daily_pct,
        F.format_string(f"Daily drawdown %.2f%%%% >= {daily_pct:g}%%%% threshold".replace("%%%%", "%%"), daily),
    ).when(
        weekly >= weekly_pct,
        F.format_string(f"Weekly drawdown %.2f%%%% >= {weekly_pct:g}%%%% threshold".replace("%%%%", "%%"), weekly),
    )
    rows = rows.withColumn("break_reason", reason)
    position = F.struct(*PNL_ORDER)
    first = rows.filter(F.col("break_reason").isNotNull()).select(F.min(position).alias("at")).scalar()
    return rows.filter(first.isNull() | (position <= first))


def session_drawdown(pnl: DataFrame, keys: list[str], max_notional: float) -> DataFrame:
    """Percent below the peak once there is one, else the loss against the notional limit; keeps the
    last value when neither holds."""
    rows = reflected_sum(pnl, keys, PNL_ORDER, -F.col("pnl_usd"), "_fall", "_neg")
    cum, peak = -F.col("_neg"), F.col("_fall") - F.col("_neg")
    rows = rows.withColumn(
        "_dd",
        F.when(peak > 1e-9, F.col("_fall") / peak * 100).when(cum < -1e-9, F.abs(cum) / max_notional * 100),
    )
    rows = running(rows, keys, PNL_ORDER, session_drawdown_pct=last_of(F.col("_dd"), "current"))
    return rows.withColumn("session_drawdown_pct", F.coalesce("session_drawdown_pct", F.lit(0.0))).drop(
        "_fall", "_neg", "_dd", "_chunk"
    )


def order_notional(price_fp: Column, qty_fp: Column, scale: int = RISK_SCALE) -> Column:
    price = F.when(price_fp == 0, F.lit(1.0)).otherwise(price_fp / F.lit(float(scale)))
    return price * (qty_fp / F.lit(float(scale)))


@dataclass(frozen=True)
class RiskLimits:
    max_notional: int = 1_000_000
    max_symbol_notional: int = 200_000
    max_order_rate: int = 100
    max_cancel_rate: int = 50
    max_slippage_bp: int = 10
    max_drawdown_pct: int = 5
    throttle_fraction: float = 0.8


def risk_check(rows: DataFrame, limits: RiskLimits) -> DataFrame:
    """Seven limits on rows that carry the running risk columns known before the order: notional,
    total_notional, symbol_notional, order_rate, cancel_rate, slippage_bp, drawdown_pct."""
    total = F.col("total_notional") + F.col("notional")
    symbol = F.col("symbol_notional") + F.col("notional")
    rate = F.col("order_rate")
    soft = limits.max_order_rate * limits.throttle_fraction
    lim = limits
    checks = [
        (total > lim.max_notional, F.format_string(f"Total notional %.2f > max {lim.max_notional}", total)),
        (symbol > lim.max_symbol_notional, F.format_string(f"Symbol %d notional %.2f > max {lim.max_symbol_notional}", F.col("symbol_id"), symbol)),
        (rate >= lim.max_order_rate, F.format_string(f"Order rate %d/s >= max {lim.max_order_rate}/s", rate)),
        (F.col("cancel_rate") >= lim.max_cancel_rate, F.format_string(f"Cancel rate %d/s >= max {lim.max_cancel_rate}/s", F.col("cancel_rate"))),
        (F.col("slippage_bp") > lim.max_slippage_bp, F.format_string(f"Cumulative slippage %.2fbp > max {lim.max_slippage_bp}bp", F.col("slippage_bp"))),
        (F.col("drawdown_pct") > lim.max_drawdown_pct, F.format_string(f"Session drawdown %.2f%% > max {lim.max_drawdown_pct}%%", F.col("drawdown_pct"))),
        (rate >= soft, F.format_string(f"Order rate %d/s >= throttle threshold {soft:.0f}/s ({lim.throttle_fraction * 100:.0f}%% of max)", rate)),
    ]
    violations = F.filter(F.array(*[F.when(hit, text) for hit, text in checks]), lambda v: v.isNotNull())
    checked = rows.withColumn("violations", violations)
    return checked.withColumn("allowed", F.size("violations") == 0)


def with_running_notional(intents: DataFrame) -> DataFrame:
    """Notional used before each order, in total and per symbol."""
    order = ["ts_ns", "order_id"]
    rows = intents.withColumn("notional", order_notional(F.col("price_fp"), F.col("qty_fp")))
    rows = running(rows, [], order, total_notional=sum_of(F.col("notional"), "previous"))
    return running(rows, ["symbol_id"], order, symbol_notional=sum_of(F.col("notional"), "previous")).drop("_chunk")


def rates(events: DataFrame, keys: list[str], time: str, tie: str, width_ns: int, **conditions: Column) -> DataFrame:
    """Rolling counts of the rows that meet each condition, in one pass."""
    return rolling_counts(events, keys, time, tie, width_ns, **conditions)


def cumulative(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return running(rows, keys, order, **{name: sum_of(value)}).drop("_chunk")


# --- breakers and latches ----------------------------------------------------------------------------


def error_breaker(results: DataFrame, keys: list[str], order: list[str], max_errors: int) -> DataFrame:
    """``ok`` rows end a run of errors; a run of ``max_errors`` triggers."""
    rows = running(results, keys, order, _island=count_of(F.col("ok")))
    rows = running(rows, [*keys, "_island"], order, consecutive_errors=count_of(~F.col("ok")))
    n = F.col("consecutive_errors")
    triggered = ~F.col("ok") & (n >= max_errors)
    return rows.withColumns(
        {
            "triggered": triggered,
            "reason": F.when(triggered, F.format_string(f"%d consecutive errors >= max {max_errors}", n)),
        }
    ).drop("_island", "_chunk")


def latch(rows: DataFrame, keys: list[str], order: list[str], reason: Column, reset: Column) -> DataFrame:
    """Once a row has a reason, it and every later row carry the first one until a reset row."""
    rows = rows.withColumns({"_why": reason, "_reset": reset})
    rows = running(rows, keys, order, _epoch=count_of(F.col("_reset")))
    # the first reason of an epoch: ordered text position is kept by the smallest order struct
    at = F.when(F.col("_why").isNotNull() & ~F.col("_reset"), F.struct(*order, F.col("_why")))
    rows = running(rows, [*keys, "_epoch"], order, _first=first_seen(at))
    return rows.withColumns(
        {"active": F.col("_first").isNotNull(), "active_reason": F.col("_first._why")}
    ).drop("_why", "_reset", "_epoch", "_first", "_chunk")


def first_seen(value: Column):
    """Running minimum of a struct that starts with the order: the first non-null one."""
    from bookweave.operators.ordered import min_of

    return min_of(value)


def breaker_reason(drawdown_reason: Column, venue_id: Column, healthy: Column, halted: Column) -> Column:
    """Priority: drawdown, venue unhealthy, venue halted."""
    return F.coalesce(
        drawdown_reason,
        F.when(~healthy, F.format_string("Venue %d is unhealthy", venue_id)),
        F.when(halted, F.format_string("Venue %d is halted", venue_id)),
    )


def running_peak(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    return running(rows, keys, order, **{name: max_of(value)}).drop("_chunk")


def cusum(rows: DataFrame, keys: list[str], order: list[str], value: Column, mean: Column, k: float, h: float) -> DataFrame:
    """One-sided CUSUM ``S = max(0, S + x - mean - k)`` with an alarm above ``h``."""
    out = reflected_sum(rows, keys, order, value - mean - k, "cusum")
    return out.withColumn("alarm", F.col("cusum") > h).drop("_chunk")


def trailing_mean(rows: DataFrame, keys: list[str], order: list[str], value: Column, span: int, name: str) -> DataFrame:
    """Mean of the ``span`` rows before each row: prefix sums minus the prefix ``span`` rows earlier,
    joined on the row number."""
    base = running(
        rows.withColumn("_v", value), keys, order,
        _n=count_of(upto="previous"), _s=sum_of(F.col("_v"), "previous"),
    ).withColumns({"_n": F.coalesce("_n", F.lit(0)), "_s": F.coalesce("_s", F.lit(0.0))})
    earlier = base.select(*keys, (F.col("_n") + span).alias("_n"), F.col("_s").alias("_s0"))
    joined = base.join(earlier, [*keys, "_n"], "left")
    rows_used = F.least(F.col("_n"), F.lit(span))
    mean = F.when(rows_used > 0, (F.col("_s") - F.coalesce("_s0", F.lit(0.0))) / rows_used)
    return joined.withColumn(name, mean).drop("_n", "_s", "_s0", "_v")


def alert_step(cooldown: int):
    def step(rows, before):
        expiry = int(before["expiry"]) if before else -(2**63)
        out = []
        for ts, seq in zip(rows.ts_ns, rows.seq):
            sent = int(ts) >= expiry
            if sent:
                expiry = int(ts) + cooldown
            out.append((int(ts), int(seq), sent))
        return out, {"expiry": expiry}

    return step


def alert_cooldown(alerts: DataFrame, cooldown_ns: int, rows_per_round: int = 1_000_000) -> DataFrame:
    """Greedy per type: an alert goes out when none of its type did within the cooldown.

    An alert that comes a cooldown or more after the one before it goes out whatever was sent earlier. A type is
    cut there into bundles that are folded side by side; only alerts that never pause so long for more than
    ``rows_per_round`` of them are folded in rounds."""
    keys, order = ["alert_type"], ["ts_ns", "seq"]
    rows = running(alerts.select("alert_type", "ts_ns", "seq"), keys, order, _prev=lag_of(F.col("ts_ns")))
    opens = F.coalesce(F.col("ts_ns") - F.col("_prev.v") >= cooldown_ns, F.lit(True))
    rows = independent_bundles(uncombined(rows).withColumn("_free", opens).drop("_prev"), keys, order, F.col("_free"), rows_per_round)
    return fold_in_rounds(
        rows.drop("_free"), [*keys, "_bundle"], order, alert_step(cooldown_ns), ["expiry"], "ts_ns bigint, seq bigint, sent boolean", rows_per_round
    )[0].drop("_bundle")


def alert_rows(breaker: DataFrame, kill: DataFrame) -> DataFrame:
    """Circuit-breaker and kill-switch events (ts_ns, seq, reason) as critical alerts."""

    def shaped(df: DataFrame, kind: str, words: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("alert_type"),
            F.lit("critical").alias("severity"),
            F.concat(F.lit(words), F.lit(": "), "reason").alias("message"),
            "ts_ns",
            "seq",
        )

    return shaped(breaker, "circuit_breaker", "Circuit breaker triggered").unionByName(
        shaped(kill, "kill_switch", "Kill switch activated")
    )
