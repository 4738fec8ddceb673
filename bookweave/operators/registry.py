"""Model registry, reconciliation, reservoirs and read views: small tables, same DataFrame style."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.operators.topk import latest_per_key, newest_per_key
from bookweave.schemas import RISK_SCALE
from bookweave.session import cut_lineage

# --- model registry ------------------------------------------------------------------------------------


def register_models(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Append new versions; a (name, version) that is there already, or twice in the batch, is an
    error."""
    both = registry.unionByName(new, allowMissingColumns=True)
    twice = both.groupBy("name", "version").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"model {twice[0]['name']} version {twice[0]['version']} exists")
    return both


def promote(registry: DataFrame, model_id: int, at: Column) -> DataFrame:
    """Activate one model and retire every other active version of its name."""
    found = registry.filter(F.col("model_id") == model_id).select("name").limit(1).collect()
    if not found:
        raise ValueError(f"unknown model {model_id}")
    chosen = F.col("model_id") == model_id
    active = F.col("promoted_at").isNotNull() & F.col("retired_at").isNull()
    other = ~chosen & (F.col("name") == found[0]["name"]) & active
    return registry.withColumns(
        {
            "promoted_at": F.when(chosen, at).otherwise(F.col("promoted_at")),
            "retired_at": F.when(other, at).when(~chosen, F.col("retired_at")),
        }
    )


def retire(registry: DataFrame, model_id: int, at: Column) -> DataFrame:
    """Retire a model that is not retired yet; an error if there is none."""
    hit = (F.col("model_id") == model_id) & F.col("retired_at").isNull()
    if not registry.filter(hit).limit(1).collect():
        raise ValueError(f"no unretired model {model_id}")
    return registry.withColumn("retired_at", F.when(hit, at).otherwise(F.col("retired_at")))


def active_models(registry: DataFrame) -> DataFrame:
    """Newest promoted, not retired model of every name."""
    live = registry.filter(F.col("promoted_at").isNotNull() & F.col("retired_at").isNull())
    return latest_per_key(live, ["name"], ["promoted_at", "version"])


def model_history(registry: DataFrame, name: str) -> DataFrame:
    return registry.filter(F.col("name") == name).orderBy(F.desc("version"))


def best_checkpoint(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest validation loss, the earliest epoch on ties."""
    rest = [c for c in metrics.columns if c not in keys]
    best = metrics.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("val_loss", "epoch")).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


# --- reconciliation -----------------------------------------------------------------------------------------


def _scaled(balance: Column) -> Column:
    return F.round(balance * RISK_SCALE).cast("bigint")


def reconcile(balances: DataFrame, positions: DataFrame) -> DataFrame:
    """Exchange balances (asset, balance) against positions (symbol_id, net_qty_fp): mismatch rows and
    warnings for unknown assets that are not empty."""
    known = positions.select(F.col("symbol_id").cast("string").alias("asset"), "symbol_id", "net_qty_fp")
    joined = balances.join(known, "asset", "left")
    unknown = F.col("symbol_id").isNull() & (F.col("balance") != 0)
    differs = F.col("net_qty_fp") != _scaled(F.col("balance"))
    action = F.when(
        F.col("net_qty_fp") == 0, F.format_string("close exchange position of %.6f", F.col("balance"))
    ).otherwise(
        F.format_string("adjust internal position from %d to match exchange %.6f", F.col("net_qty_fp"), F.col("balance"))
    )
    warning = F.format_string("Unknown exchange balance: asset=%s, balance=%.6f", F.col("asset"), F.col("balance"))
    kind = F.when(unknown, "warning").when(differs, "mismatch")
    return joined.withColumns(
        {"kind": kind, "action": F.when(unknown, warning).when(differs, action)}
    ).filter(F.col("kind").isNotNull())


def stale_orders(exchange: DataFrame, internal: DataFrame) -> DataFrame:
    return exchange.join(internal.select("order_id"), "order_id", "left_anti")


def mapped_mismatches(balances: DataFrame, mapping: DataFrame, positions: DataFrame) -> DataFrame:
    """Mismatches of mapped assets only; a missing position counts as 0."""
    joined = balances.join(mapping, "asset").join(positions.select("symbol_id", "net_qty_fp"), "symbol_id", "left")
    net = F.coalesce("net_qty_fp", F.lit(0).cast("bigint"))
    actual = _scaled(F.col("balance"))
    rows = joined.withColumn("net_qty_fp", net).filter(net != actual)
    net = F.col("net_qty_fp")
    action = (
        F.when(net == 0, F.format_string("close exchange position of %.6f", F.col("balance")))
        .when(F.col("balance") == 0, F.format_string("internal position %d has no exchange counterpart", net))
        .otherwise(F.format_string("adjust: internal=%d, exchange=%d", net, actual))
    )
    return rows.withColumn("action", action)


# --- reservoirs, sketches, latency ---------------------------------------------------------------------------


def reservoir(rows: DataFrame, key: str, capacity: int, seed: str = "0") -> DataFrame:
    """A uniform sample of at most ``capacity`` keys: those with the smallest seeded hash, so the same
    rows are kept whatever the partitioning."""
    spot = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    return rows.withColumn("_spot", spot).orderBy("_spot").limit(capacity).drop("_spot")


def admitted(segments: DataFrame, capacity: int, min_uncertainty: float = 0.18, min_impact_bp: float = 1.5) -> DataFrame:
    passed = segments.filter((F.col("uncertainty") >= min_uncertainty) & (F.col("impact_bp") >= min_impact_bp))
    return reservoir(passed, "segment_id", capacity)


def heavy_hitters(rows: DataFrame, value: str, k: int = 256) -> DataFrame:
    """Most frequent values with their exact counts."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(k)


def heavy_hitters_sketch(rows: DataFrame, value: str, k: int = 256, tracked: int = 10_000) -> DataFrame:
    """Most frequent values from a mergeable sketch of ``tracked`` values; counts may be too high."""
    top = rows.agg(F.expr(f"approx_top_k({value}, {k}, {tracked})").alias("top"))
    return top.select(F.inline("top")).withColumnsRenamed({"item": value, "count": "n"})


def frequency_sketch(rows: DataFrame, value: str, eps: float = 0.001, confidence: float = 0.98) -> DataFrame:
    """Count-min sketch as one binary value."""
    return rows.agg(F.count_min_sketch(F.col(value), F.lit(eps), F.lit(confidence), F.lit(7)).alias("sketch"))


def frequency_table(rows: DataFrame, value: str, eps: float = 0.001, confidence: float = 0.98) -> DataFrame:
    """Count-min sketch as a table (line, cell, n): each value counts in one cell of every line, so sketches of
    parts add up and no task holds more than the cells. Lines and cells follow from ``eps`` and ``confidence``."""
    return rows.filter(F.col(value).isNotNull()).select(F.explode(_cells(F.col(value), eps, confidence)).alias("c")).groupBy("c.line", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def frequency_estimates(sketch: DataFrame, values: DataFrame, value: str, eps: float = 0.001, confidence: float = 0.98) -> DataFrame:
    """Estimated count of each value: its least cell. Never below the true count; above it by more than
    eps * all rows with a chance of 1 - confidence."""
    asked = values.select(value).distinct().withColumn("c", F.explode(_cells(F.col(value), eps, confidence)))
    found = asked.select(value, "c.line", "c.cell").join(sketch, ["line", "cell"], "left")
    return found.groupBy(value).agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("estimate"))


def _cells(value: Column, eps: float, confidence: float) -> Column:
    lines, width = max(1, math.ceil(-math.log2(1 - confidence))), math.ceil(2 / eps)
    text = lambda k: F.concat(F.lit(f"{k}:"), value.cast("string"))
    cell = lambda k: F.conv(F.substring(F.md5(text(k).cast("binary")), 1, 8), 16, 10).cast("bigint") % width
    return F.array(*[F.struct(F.lit(k).alias("line"), cell(k).alias("cell")) for k in range(lines)])


def latency_summary(samples: DataFrame, newest: int | None = None) -> DataFrame:
    """Mean and exact percentiles (sorted[floor(n*p)]) per stage, of all samples or only of the ``newest`` ones.
    Ranks come from the counts of the distinct values, so that repeated values cost one row."""
    from bookweave.operators.ordered import running, sum_of

    if newest is not None:
        samples = newest_per_key(samples, ["stage"], [F.desc("ts_ns"), F.desc("seq")], newest).drop("rank")
    values = samples.groupBy("stage", "value").agg(F.count(F.lit(1)).alias("_times"))
    values = cut_lineage(values)
    upto = running(values, ["stage"], ["value"], _upto=sum_of(F.col("_times"))).drop("_chunk")
    totals = values.groupBy("stage").agg(F.sum("_times").alias("count"), (F.sum(F.col("value") * F.col("_times")) / F.sum("_times")).alias("avg"))
    ranked = upto.join(totals, "stage")
    # the value at 0-based rank r is the smallest one with more than r samples up to it
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("count") * p), F.col("count") - 1), F.col("value")))
    return ranked.groupBy("stage").agg(
        F.max("avg").alias("avg"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("count").alias("count")
    )


def latency_summary_approx(samples: DataFrame) -> DataFrame:
    """Percentiles of all samples from a mergeable summary."""
    q = F.percentile_approx("value", [0.5, 0.95, 0.99])
    return samples.groupBy("stage").agg(F.avg("value").alias("avg"), q.alias("q"), F.count(F.lit(1)).alias("count")).select(
        "stage", "avg", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "count"
    )


# --- read views ------------------------------------------------------------------------------------------------


def newest_segments(segments: DataFrame, column: str, value, limit: int) -> DataFrame:
    found = segments.filter(F.col(column) == value)
    return found.orderBy(F.desc("start_ts_ns"), F.desc("segment_id")).limit(limit)


def history_tail(alerts: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` alerts, oldest first."""
    newest = alerts.orderBy(F.desc("ts_ns"), F.desc("seq")).limit(limit)
    return newest.orderBy("ts_ns", "seq")


def embedding_rows(df: DataFrame) -> DataFrame:
    """Embedding table rows; a vector whose size is not its dimension fails the write."""
    checked = F.when(F.size("vector") == F.col("dimension"), F.col("vector")).otherwise(
        F.raise_error(F.format_string("embedding %d: wrong dimension", F.col("embedding_id"))).cast("array<float>")
    )
    return df.withColumn("vector", checked)


def channels(events: DataFrame, predictions: DataFrame, fills: DataFrame, breaker: DataFrame, kill: DataFrame, decisions: DataFrame) -> DataFrame:
    """Bus rows as (channel, symbol_id, ts_ns, payload JSON); a gate decision becomes an alert only
    when it blocks acting."""

    def rows(df: DataFrame, channel: str, symbol: Column, **fields: Column) -> DataFrame:
        body = F.struct(F.lit(channel).alias("channel"), *[v.alias(k) for k, v in fields.items()])
        return df.select(F.lit(channel).alias("channel"), symbol.cast("int").alias("symbol_id"), "ts_ns", F.to_json(body).alias("payload"))

    c, text = F.col, lambda n: F.col(n).cast("string")
    none = F.lit(None)
    parts = [
        rows(events, "ticks", c("symbol_id"), type=F.lit("tick"), eventId=c("event_id"), symbolId=c("symbol_id"), eventType=c("event_type"),
             priceFp=text("price_fp"), qtyFp=text("qty_fp"), tsNs=text("ts_ns")),
        rows(predictions, "predictions", c("symbol_id"), type=F.lit("prediction"), symbolId=c("symbol_id"), prediction=c("value"),
             confidence=c("confidence"), horizon=c("head_name"), tsNs=text("ts_ns")),
        rows(fills, "fills", c("symbol_id"), type=F.lit("fill"), orderId=c("order_id"), symbolId=c("symbol_id"), venueId=c("venue_id"),
             fillPrice=text("price_fp"), fillQty=text("qty_fp"), tsNs=text("ts_ns")),
        rows(breaker, "alerts", c("symbol_id"), type=F.lit("circuit_breaker"), reason=c("reason"), symbolId=c("symbol_id"), tsNs=text("ts_ns")),
        rows(kill, "alerts", none, type=F.lit("kill_switch"), reason=c("reason"), operator=c("operator"), tsNs=text("ts_ns")),
        rows(decisions.filter(~c("allow_act")), "alerts", none, type=F.lit("coherence_blocked"), reasons=c("reasons"), driftScore=c("drift_score"), tsNs=text("ts_ns")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def symbol_dimension(rows: DataFrame, **defaults: Column) -> DataFrame:
    """Distinct symbols with defaults for the settings a row does not carry."""
    return rows.distinct().withColumns({n: F.coalesce(F.col(n), d) if n in rows.columns else d for n, d in defaults.items()})
