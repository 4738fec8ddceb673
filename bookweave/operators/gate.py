"""Coherence gate, ensemble gating, policy rules and the context they need. Column logic only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.operators.ordered import last_of, running, uncombined

# Gate thresholds per regime (Calm, Normal, Volatile): min cut, max drift, max cusum.
THRESHOLDS = [(0.3, 1.5, 5.0), (0.5, 1.0, 4.0), (0.8, 0.5, 2.0)]


def metric_columns() -> list[Column]:
    """Gate inputs as aggregates over long control rows (head_name, value, confidence)."""
    head = F.col("head_name")
    return [
        F.coalesce(F.max(F.when(head == "regime_uncertainty", F.col("confidence"))), F.lit(0.5)).alias("mincut"),
        F.coalesce(F.max(F.when(head == "adversarial_drift", F.col("value"))), F.lit(0.0)).alias("drift"),
        F.coalesce(F.max(F.when(head == "adversarial_drift", F.col("confidence"))), F.lit(0.0)).alias("cusum"),
    ]


def coherence_metrics(controls: DataFrame, keys: list[str]) -> DataFrame:
    return controls.groupBy(*keys).agg(*metric_columns())


def coherence_gate(metrics: DataFrame, regime: str = "regime") -> DataFrame:
    """Decision columns from (mincut, drift, cusum) and a regime code 0..2."""
    limits = F.array(
        *[F.struct(F.lit(a).alias("mincut"), F.lit(b).alias("drift"), F.lit(c).alias("cusum")) for a, b, c in THRESHOLDS]
    )
    limit = F.element_at(limits, F.col(regime) + 1)
    checks = [
        (F.col("mincut") < limit["mincut"], "mincut", "<"),
        (F.col("drift") > limit["drift"], "drift", ">"),
        (F.col("cusum") > limit["cusum"], "cusum", ">"),
    ]
    found = [
        F.when(hit, F.format_string(f"{name} %.6f {sign} threshold %.1f", F.col(name), limit[name]))
        for hit, name, sign in checks
    ]
    reasons = F.filter(F.array(*found), lambda r: r.isNotNull())
    decided = metrics.withColumn("reasons", reasons)
    calm = F.size("reasons") == 0
    return decided.withColumns(
        {
            "allow_retrieve": F.lit(True),
            "allow_write": calm,
            "allow_learn": F.lit(True),
            "allow_act": calm,
            "mincut_value": F.floor(F.col("mincut") * 1000).cast("bigint"),
            "drift_score": F.col("drift"),
            "cusum_score": F.col("cusum"),
        }
    )


def confidence_multiplier(drift: Column, cusum: Column, allow_learn: Column) -> Column:
    drift_part = 1 / (1 + F.exp(5 * (drift - 0.5)))
    cusum_part = F.greatest(F.lit(0.0), 1 - 0.5 * cusum)
    learn_part = F.when(allow_learn, F.lit(1.0)).otherwise(F.lit(0.8))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), drift_part * cusum_part * learn_part))


def gate_ensemble(signals: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Scale prediction and control confidences (``signal_kind``) by the gate's multiplier; predictions
    need allow_retrieve, controls allow_act."""
    slim = decisions.select(
        *keys, "allow_retrieve", "allow_act",
        confidence_multiplier(F.col("drift_score"), F.col("cusum_score"), F.col("allow_learn")).alias("_m"),
    )
    allowed = F.when(F.col("signal_kind") == "prediction", F.col("allow_retrieve")).otherwise(F.col("allow_act"))
    return (
        signals.join(slim, keys)
        .withColumn("confidence", F.when(allowed, F.col("confidence") * F.col("_m")).otherwise(F.lit(0.0)))
        .drop("_m", "allow_retrieve", "allow_act")
    )


# --- policy ------------------------------------------------------------------------------------------

# Control heads as emitted by models -> names the policy reads.
HEAD_TO_SIGNAL = {
    "place": "place_signal",
    "modify": "modify_signal",
    "cancel": "cancel_signal",
    "side": "side_signal",
    "size": "size_signal",
    "urgency": "urgency_signal",
    "regime_uncertainty": "regime_uncertainty",
    "adversarial_drift": "adversarial_drift",
}

ACTION = (
    "struct<type:string,rule:string,detail:string,resume_after_ns:bigint,symbol_id:int,venue_id:int,side:int,"
    "price_fp:bigint,qty_fp:bigint,order_type:string,time_in_force:string>"
)
Rule = Callable[[], Column]


def signal_columns() -> list[Column]:
    """One aggregate per policy signal over long control rows; absent heads read as 0."""
    return [
        F.coalesce(F.max(F.when(F.col("head_name") == head, F.col("value"))), F.lit(0.0)).alias(name)
        for head, name in HEAD_TO_SIGNAL.items()
    ]


def control_signals(controls: DataFrame, keys: list[str]) -> DataFrame:
    return controls.groupBy(*keys).agg(*signal_columns())


def signals_and_metrics(controls: DataFrame, keys: list[str]) -> DataFrame:
    """Policy signals and gate inputs from one aggregate."""
    return controls.groupBy(*keys).agg(*signal_columns(), *metric_columns())


def _action(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in ACTION[7:-1].split(",")]
    parts = [fields.get(n, F.lit(None)).alias(n) for n in names]
    return F.struct(*parts).cast(ACTION)


def hold(rule: str, detail: Column) -> Column:
    return _action(type=F.lit("hold"), rule=F.lit(rule), detail=detail)


def kill_switch_rule() -> Column:
    return F.when(F.col("kill_active"), hold("kill_switch", F.lit("Kill switch is active -- all trading halted")))


def venue_rule() -> Column:
    bad = F.col("venue_halted") | ~F.col("venue_healthy")
    detail = F.when(F.col("venue_halted"), "Venue is halted").otherwise("Venue is unhealthy")
    return F.when(bad, hold("venue_health", detail))


def coherence_rule() -> Column:
    detail = F.concat(F.lit("Coherence blocked action: "), F.array_join("reasons", "; "))
    return F.when(~F.col("allow_act"), hold("coherence_gate", detail))


def regime_rule() -> Column:
    hit = (F.col("regime_uncertainty") > 0.7) & (F.col("size_signal") > 0.5)
    detail = F.format_string(
        "Regime uncertainty %.3f > 0.7 with upsize signal %.3f", F.col("regime_uncertainty"), F.col("size_signal")
    )
    return F.when(hit, hold("regime_uncertainty", detail))


def drift_rule() -> Column:
    detail = F.format_string("Adversarial drift %.3f > 0.6", F.col("adversarial_drift"))
    return F.when(F.col("adversarial_drift") > 0.6, hold("adversarial_drift", detail))


def slippage_rule() -> Column:
    detail = F.format_string("Cumulative slippage %.2fbp > 5bp", F.col("slippage_bp"))
    return F.when(F.col("slippage_bp") > 5, hold("slippage_drift", detail))


def throttle_rule() -> Column:
    """Rates are ratios of the limit (count / limit)."""
    hit = (F.col("order_rate_ratio") > 0.9) | (F.col("cancel_rate_ratio") > 0.9)
    detail = F.format_string(
        "Rate limit approaching: orders=%.2f, cancels=%.2f", F.col("order_rate_ratio"), F.col("cancel_rate_ratio")
    )
    return F.when(
        hit, _action(type=F.lit("throttle"), rule=F.lit("rate_throttle"), detail=detail, resume_after_ns=F.col("ts_ns") + 1_000_000_000)
    )


def order_intent() -> Column:
    urgency = F.col("urgency_signal")
    order_type = F.when(urgency > 0.8, "ioc").when(urgency > 0.5, "marketable_limit").otherwise("limit")
    size = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("size_signal")))
    return _action(
        type=F.lit("place"),
        symbol_id=F.col("symbol_id"),
        venue_id=F.col("venue_id"),
        side=F.when(F.col("side_signal") > 0.5, 0).otherwise(1),
        price_fp=F.lit(0),
        qty_fp=F.round(size * 1_000_000),
        order_type=order_type,
        time_in_force=F.when(order_type == "ioc", "fok").otherwise("day"),
    )


def signal_action() -> Column:
    """The strongest of place, modify, cancel (ties in that order); hold when all are weak."""
    place, modify, cancel = F.col("place_signal"), F.col("modify_signal"), F.col("cancel_signal")
    best = F.greatest(place, modify, cancel)
    return (
        F.when(best < 0.1, hold("no_signal", F.lit("All control signals below threshold")))
        .when(place == best, order_intent())
        .when(modify == best, _action(type=F.lit("modify"), detail=F.lit("")))
        .otherwise(_action(type=F.lit("cancel"), detail=F.lit("Model cancel signal triggered")))
    )


RULES: list[tuple[str, Rule]] = [
    ("kill_switch", kill_switch_rule),
    ("venue_health", venue_rule),
    ("coherence_gate", coherence_rule),
    ("regime_uncertainty", regime_rule),
    ("adversarial_drift", drift_rule),
    ("slippage_drift", slippage_rule),
    ("rate_throttle", throttle_rule),
]


def decide(context: DataFrame, extra_rules: list[tuple[str, Rule]] | None = None) -> DataFrame:
    """First matching rule wins, else the signal's action. ``extra_rules`` (functions that give an
    action column or null) run after the built-in ones."""
    chain = [rule() for _, rule in [*RULES, *(extra_rules or [])]]
    return context.withColumn("action", F.coalesce(*chain, signal_action()))


# --- state known at an event -----------------------------------------------------------------------------


def as_of(events: DataFrame, states: DataFrame, keys: list[str], time: str, tie: str, columns: list[str]) -> DataFrame:
    """Latest state row of the key at or before each event: both sides are put into one time order and
    the last state is carried forward, so there is no range join and no hot-key task."""
    payload = F.struct(*columns)
    events = uncombined(events)
    left = events.select("*", F.lit(1).alias("_kind"), F.lit(None).alias("_state"))
    right = states.select(*keys, time, tie, F.lit(0).alias("_kind"), payload.alias("_state"))
    both = left.drop("_state").unionByName(right, allowMissingColumns=True)
    order = [time, "_kind", tie]
    carried = running(both, keys, order, _known=last_of(F.col("_state"), "current"))
    mark = carried.schema["_known"].metadata
    return carried.filter("_kind = 1").select(
        *events.columns, *[F.col("_known")[c].alias(c, metadata=mark) for c in columns]
    )


def decision_context(events: DataFrame, sources: list[tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Policy input per event: for each ``(states, keys, columns)`` the state known at the event's time
    (states have ts_ns and seq)."""
    out = events
    for states, keys, columns in sources:
        out = as_of(out, states, keys, "ts_ns", "seq", columns)
    return out
