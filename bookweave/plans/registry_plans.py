"""Registry, reconciliation, sketch and view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookweave.functions.scalars import int_div
from bookweave.operators import pnl as P
from bookweave.operators import registry as R
from bookweave.operators.topk import latest_per_key
from bookweave.plans.catalog import query
from bookweave.plans.label_plans import ME
from bookweave.plans.model_plans import MO, PO
from bookweave.plans.pnl_plans import FI
from bookweave.sources.driver_tables import HEADS as D_HEADS
from bookweave.sources.driver_tables import control_rows, fills, market_events, model_events, policy_context, table


def models(spark, d):
    """``part`` as a model registry: brand = name, key = version; size decides promotion and retirement."""
    size = F.col("p_size")
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + n * 3600)
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("name"), F.col("p_partkey").cast("int").alias("version"),
        F.when(size % 2 == 0, at(size)).alias("promoted_at"), F.when(size % 3 == 0, at(size + 100)).alias("retired_at"),
    )


MR = """WITH mr AS (SELECT p_partkey AS model_id, p_brand AS name, CAST(p_partkey AS INTEGER) AS version, CASE WHEN p_size % 2 = 0 THEN 1700000000 + p_size * 3600 END AS promoted_s,
 CASE WHEN p_size % 3 = 0 THEN 1700000000 + (p_size + 100) * 3600 END AS retired_s FROM part) """
NOW = 1_800_000_000


def shaped(df):
    return df.select("model_id", "name", "version", F.unix_seconds("promoted_at").alias("promoted_s"), F.unix_seconds("retired_at").alias("retired_s"))


def target(df):
    """The newest version of the registry's last name."""
    return df.agg(F.max_by("model_id", F.struct("name", "version")).alias("m")).first()["m"]


@query(
    "registered_models",
    "A11",
    MR + "SELECT * FROM mr UNION ALL SELECT model_id + 1000000, name, version + 1000000, NULL, NULL FROM mr",
)
def _(spark, d):
    base = models(spark, d)
    new = base.select((F.col("model_id") + 1_000_000).alias("model_id"), "name", (F.col("version") + 1_000_000).alias("version"))
    return shaped(R.register_models(base, new))


TARGET = ", tg AS (SELECT arg_max(model_id, (name, version)) AS id, max(name) AS nm FROM mr) "


@query(
    "promoted_model",
    "A12",
    MR
    + TARGET
    + f"""SELECT model_id, name, version, CASE WHEN model_id = id THEN {NOW} ELSE promoted_s END AS promoted_s,
 CASE WHEN model_id = id THEN NULL WHEN name = nm AND promoted_s IS NOT NULL AND retired_s IS NULL THEN {NOW} ELSE retired_s END AS retired_s FROM mr, tg""",
)
def _(spark, d):
    base = models(spark, d)
    return shaped(R.promote(base, target(base), F.timestamp_seconds(F.lit(NOW))))


@query(
    "retired_model",
    "A13",
    MR
    + f""", tg AS (SELECT max(model_id) AS id FROM mr WHERE retired_s IS NULL) SELECT model_id, name, version, promoted_s, CASE WHEN model_id = id THEN {NOW} ELSE retired_s END AS retired_s FROM mr, tg""",
)
def _(spark, d):
    base = models(spark, d)
    last = base.filter("retired_at IS NULL").agg(F.max("model_id")).first()[0]
    return shaped(R.retire(base, last, F.timestamp_seconds(F.lit(NOW))))


@query(
    "active_models",
    "D35",
    MR + "SELECT name, arg_max(model_id, (promoted_s, version)) AS model_id, max(promoted_s) AS promoted_s FROM mr WHERE promoted_s IS NOT NULL AND retired_s IS NULL GROUP BY 1",
)
def _(spark, d):
    return shaped(R.active_models(models(spark, d))).select("name", "model_id", "promoted_s")


@query("model_history", "F4", MR + "SELECT model_id, version FROM mr WHERE name = (SELECT max(name) FROM mr)")
def _(spark, d):
    base = models(spark, d)
    return R.model_history(base, base.agg(F.max("name")).first()[0]).select("model_id", "version")


@query(
    "best_checkpoints",
    "F10",
    ME + "SELECT symbol_id, arg_min(seq, (qty_fp / 1e8, seq)) AS epoch, min(qty_fp / 1e8) AS val_loss FROM me GROUP BY 1",
)
def _(spark, d):
    metrics = market_events(spark, d).select("symbol_id", F.col("seq").alias("epoch"), (F.col("qty_fp") / F.lit(1e8)).alias("val_loss"))
    return R.best_checkpoint(metrics, ["symbol_id"])


# --- reconciliation ---------------------------------------------------------------------------------------

NETS = """, np AS (SELECT symbol_id, sum(CASE WHEN side = 0 THEN qty_fp ELSE -qty_fp END)::BIGINT AS net FROM fills GROUP BY 1),
 bl AS (SELECT CASE WHEN symbol_id = 15 THEN 'X' || symbol_id ELSE symbol_id::VARCHAR END AS asset, symbol_id AS sid, CASE symbol_id % 4 WHEN 0 THEN net / 1e6 + 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE net / 1e6 END AS balance FROM np) """


def books(spark, d):
    net = fills(spark, d).groupBy("symbol_id").agg(F.sum(P.signed_qty()).alias("net_qty_fp"))
    exact = F.col("net_qty_fp") / F.lit(1e6)
    balance = F.when(F.col("symbol_id") % 4 == 0, exact + 0.5).when(F.col("symbol_id") % 4 == 1, F.lit(0.0)).otherwise(exact)
    name = F.when(F.col("symbol_id") == 15, F.concat(F.lit("X"), "symbol_id")).otherwise(F.col("symbol_id").cast("string"))
    return net, net.select(name.alias("asset"), balance.alias("balance"))


@query(
    "reconciliation",
    "C6",
    FI
    + NETS
    + """SELECT asset, CASE WHEN net IS NULL THEN 'warning' ELSE 'mismatch' END AS kind, CASE WHEN net IS NULL THEN printf('Unknown exchange balance: asset=%s, balance=%.6f', asset, balance)
 WHEN net = 0 THEN printf('close exchange position of %.6f', balance) ELSE printf('adjust internal position from %d to match exchange %.6f', net, balance) END AS action
 FROM bl LEFT JOIN (SELECT symbol_id::VARCHAR AS asset, net FROM np) p USING (asset) WHERE (net IS NULL AND balance <> 0) OR net <> CAST(round(balance * 1000000) AS BIGINT)""",
)
def _(spark, d):
    net, balances = books(spark, d)
    return R.reconcile(balances, net).select("asset", "kind", "action")


@query(
    "mapped_mismatches",
    "C8 B33",
    FI
    + NETS
    + """, j AS (SELECT asset, coalesce(net, 0) AS net, balance FROM bl LEFT JOIN (SELECT * FROM np WHERE symbol_id <> 6) p ON p.symbol_id = bl.sid WHERE asset <> 'X15')
 SELECT asset, net AS net_qty_fp, CASE WHEN net = 0 THEN printf('close exchange position of %.6f', balance) WHEN balance = 0 THEN printf('internal position %d has no exchange counterpart', net)
 ELSE printf('adjust: internal=%d, exchange=%d', net, CAST(round(balance * 1000000) AS BIGINT)) END AS action FROM j WHERE net <> CAST(round(balance * 1000000) AS BIGINT)""",
)
def _(spark, d):
    """Symbol 6 has a balance but no position; the odd asset is not in the map."""
    net, balances = books(spark, d)
    mapping = net.filter("symbol_id <> 15").select(F.col("symbol_id").cast("string").alias("asset"), "symbol_id")
    return R.mapped_mismatches(balances, mapping, net.filter("symbol_id <> 6")).select("asset", "net_qty_fp", "action")


@query("stale_orders", "C7 G5", "SELECT o_orderkey AS order_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def _(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "order_id")
    return R.stale_orders(orders.filter("o_orderstatus = 'O'"), orders.filter("o_totalprice > 100000")).select("order_id")


# --- sketches, samples, latency ------------------------------------------------------------------------------


@query("reservoir_store", "A18", ME + "SELECT event_id, qty_fp FROM me ORDER BY md5('0:' || event_id) LIMIT 1000")
def _(spark, d):
    return R.reservoir(market_events(spark, d).select("event_id", "qty_fp"), "event_id", 1000)


@query(
    "admitted_segments",
    "D38",
    MO + "SELECT seq AS segment_id FROM mo WHERE z / 100.0::DOUBLE >= 0.18 AND (qty_fp // 100000000) / 20.0::DOUBLE >= 1.5 ORDER BY md5('0:' || seq) LIMIT 500",
)
def _(spark, d):
    rows = model_events(spark, d).select(F.col("seq").alias("segment_id"), (F.col("z") / F.lit(100.0)).alias("uncertainty"), (int_div(F.col("qty_fp"), 100_000_000) / F.lit(20.0)).alias("impact_bp"))
    return R.admitted(rows, 500).select("segment_id")


@query("heavy_hitters", "D37", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 50")
def _(spark, d):
    return R.heavy_hitters(table(spark, d, "events"), "user_id", 50)


@query("heavy_hitters_sketch", "D37")
def _(spark, d):
    return R.heavy_hitters_sketch(table(spark, d, "events"), "user_id", 50)


@query("frequency_sketch", "D37")
def _(spark, d):
    return R.frequency_sketch(table(spark, d, "events"), "user_id").select(F.length("sketch").alias("n_bytes"))


@query(
    "frequency_estimates",
    "D37",
    """WITH c AS (SELECT user_id, line, ('0x' || left(md5(line || ':' || user_id), 8))::BIGINT % 2000 AS cell FROM events, generate_series(0, 5) AS g(line) WHERE user_id IS NOT NULL),
 t AS (SELECT line, cell, count(*) AS n FROM c GROUP BY 1, 2) SELECT user_id, min(n) AS estimate FROM (SELECT DISTINCT * FROM c) JOIN t USING (line, cell) GROUP BY 1""",
)
def _(spark, d):
    """The estimate of every user's number of events."""
    events = table(spark, d, "events")
    return R.frequency_estimates(R.frequency_table(events, "user_id"), events.filter("user_id IS NOT NULL"), "user_id")


LAT = """, s AS (SELECT event_type AS stage, qty_fp / 1e8 AS value, ts_exchange_ns, seq FROM me),
 l AS (SELECT stage, list(value ORDER BY value) AS v, avg(value) AS a FROM s GROUP BY 1)
 SELECT stage, round(a, 6) AS avg, v[floor(len(v) * 0.5)::BIGINT + 1] AS p50, v[floor(len(v) * 0.95)::BIGINT + 1] AS p95, v[least(floor(len(v) * 0.99)::BIGINT, len(v) - 1) + 1] AS p99, len(v) AS count FROM l"""


def samples(spark, d):
    return market_events(spark, d).select(F.col("event_type").alias("stage"), (F.col("qty_fp") / F.lit(1e8)).alias("value"), F.col("ts_exchange_ns").alias("ts_ns"), "seq")


@query("latency_summary", "D25", ME + LAT)
def _(spark, d):
    return R.latency_summary(samples(spark, d)).withColumn("avg", F.round("avg", 6))


@query("latency_summary_approx", "D25")
def _(spark, d):
    return R.latency_summary_approx(samples(spark, d))


# --- views ------------------------------------------------------------------------------------------------------


def segments(spark, d):
    return market_events(spark, d).select(
        F.col("seq").alias("segment_id"), "symbol_id", F.col("ts_exchange_ns").alias("start_ts_ns"),
        F.when(F.col("event_type") == 3, "action").otherwise("replay").alias("segment_kind"),
    )


@query("segments_by_symbol", "F2", ME + "SELECT seq AS segment_id, ts_exchange_ns AS start_ts_ns FROM me WHERE symbol_id = 5 ORDER BY start_ts_ns DESC, segment_id DESC LIMIT 20")
def _(spark, d):
    return R.newest_segments(segments(spark, d), "symbol_id", 5, 20).select("segment_id", "start_ts_ns")


@query("segments_by_kind", "F3", ME + "SELECT seq AS segment_id, ts_exchange_ns AS start_ts_ns FROM me WHERE event_type = 3 ORDER BY start_ts_ns DESC, segment_id DESC LIMIT 20")
def _(spark, d):
    return R.newest_segments(segments(spark, d), "segment_kind", "action", 20).select("segment_id", "start_ts_ns")


@query("alert_history", "F11", ME + "SELECT seq, ts_exchange_ns AS ts_ns FROM me WHERE event_type = 2 ORDER BY ts_ns DESC, seq DESC LIMIT 50")
def _(spark, d):
    alerts = market_events(spark, d).filter("event_type = 2").select("seq", F.col("ts_exchange_ns").alias("ts_ns"))
    return R.history_tail(alerts, 50)


@query("latest_per_symbol", "F14", ME + "SELECT symbol_id, arg_max(seq, (ts_exchange_ns, seq)) AS seq, arg_max(price_fp, (ts_exchange_ns, seq)) AS price_fp, max(ts_exchange_ns) AS ts_exchange_ns FROM me GROUP BY 1")
def _(spark, d):
    return latest_per_key(market_events(spark, d).select("symbol_id", "seq", "price_fp", "ts_exchange_ns"), ["symbol_id"], ["ts_exchange_ns", "seq"])


@query(
    "dimension_tables",
    "A16",
    ME + "SELECT symbol_id, 'S' || symbol_id AS name, venue_id, 0.01::DOUBLE AS tick_size, 0.001::DOUBLE AS lot_size FROM (SELECT DISTINCT symbol_id, venue_id FROM me)",
)
def _(spark, d):
    rows = market_events(spark, d).select("symbol_id", F.concat(F.lit("S"), "symbol_id").alias("name"), "venue_id")
    return R.symbol_dimension(rows, tick_size=F.lit(0.01), lot_size=F.lit(0.001))


@query(
    "embedding_rows",
    "A17",
    "SELECT vec_id AS embedding_id, 64 AS dimension, 'label' || label AS embedding_type, len(embedding) AS n FROM embeddings",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("embedding_id"), F.lit(64).alias("dimension"), F.concat(F.lit("label"), "label").alias("embedding_type"), F.col("embedding").alias("vector")
    )
    return R.embedding_rows(rows).select("embedding_id", "dimension", "embedding_type", F.size("vector").alias("n"))


@query(
    "channel_rows",
    "A14",
    PO
    + """SELECT 'ticks' AS channel, symbol_id, ts_ns, printf('{"channel":"ticks","type":"tick","eventId":"%s","symbolId":%d,"eventType":%d,"priceFp":"%d","qtyFp":"%d","tsNs":"%d"}', event_id, symbol_id, event_type, price_fp, qty_fp, ts_ns) AS payload FROM mo
 UNION ALL SELECT 'fills', symbol_id, ts_ns, printf('{"channel":"fills","type":"fill","orderId":"o%d","symbolId":%d,"venueId":%d,"fillPrice":"%d","fillQty":"%d","tsNs":"%d"}', seq, symbol_id, venue_id, price_fp // 100, qty_fp // 100, ts_ns) FROM mo WHERE event_type = 3
 UNION ALL SELECT 'alerts', symbol_id, ts_ns, printf('{"channel":"alerts","type":"circuit_breaker","reason":"quantity 2","symbolId":%d,"tsNs":"%d"}', symbol_id, ts_ns) FROM mo WHERE qty_fp = 200000000
 UNION ALL SELECT 'alerts', NULL, ts_ns, printf('{"channel":"alerts","type":"kill_switch","reason":"quantity 1","operator":"op","tsNs":"%d"}', ts_ns) FROM mo WHERE qty_fp = 100000000
 UNION ALL SELECT 'predictions', symbol_id, ts_ns, '{"channel":"predictions","type":"prediction","symbolId":' || symbol_id || ',"prediction":' || round(value, 6) || ',"confidence":' || round(confidence, 6) || ',"horizon":"' || head || '","tsNs":"' || ts_ns || '"}'
   FROM (SELECT symbol_id, ts_ns, unnest(["""
    + ", ".join(f"'{n}'" for n, _, _ in D_HEADS)
    + """]) AS head, unnest(["""
    + ", ".join(f"{n}_v" for n, _, _ in D_HEADS)
    + """]) AS value, unnest(["""
    + ", ".join({"regime_uncertainty": "mincut", "adversarial_drift": "cusum"}.get(n, "0.9::DOUBLE") for n, _, _ in D_HEADS)
    + """]) AS confidence FROM hd)
 UNION ALL SELECT 'alerts', NULL, ts_ns, '{"channel":"alerts","type":"coherence_blocked","reasons":[' || array_to_string(list_transform(reasons, lambda r: '"' || r || '"'), ',') || '],"driftScore":' || round(drift, 6) || ',"tsNs":"' || ts_ns || '"}' FROM ctx WHERE NOT allow_act""",
)
def _(spark, d):
    """The payload of every channel."""
    return _channels(spark, d)


def _channels(spark, d):
    e = model_events(spark, d)
    filled = fills(spark, d).withColumn("order_id", F.concat(F.lit("o"), "seq"))
    breaker = e.filter("qty_fp = 200000000").withColumn("reason", F.lit("quantity 2"))
    kill = e.filter("qty_fp = 100000000").withColumns({"reason": F.lit("quantity 1"), "operator": F.lit("op")})
    six = lambda rows, *names: rows.withColumns({n: F.round(n, 6) for n in names})
    return R.channels(e, six(control_rows(spark, d), "value", "confidence"), filled, breaker, kill, six(policy_context(spark, d), "drift_score"))


@query(
    "channel_counts",
    "A14",
    PO
    + """SELECT channel, sum(n)::BIGINT AS n FROM (SELECT 'ticks' AS channel, count(*) AS n FROM mo UNION ALL SELECT 'predictions', 8 * count(*) FROM mo UNION ALL SELECT 'fills', count(*) FROM mo WHERE event_type = 3
 UNION ALL SELECT 'alerts', count(*) FROM mo WHERE qty_fp IN (100000000, 200000000) UNION ALL SELECT 'alerts', count(*) FROM ctx WHERE NOT allow_act) GROUP BY 1""",
)
def _(spark, d):
    return _channels(spark, d).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
