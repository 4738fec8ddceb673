"""Views of the given tables in the shape of market data (deterministic, row by row)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.functions.scalars import event_id, int_div
from bookweave.schemas import DAY_NS, RISK_SCALE
from bookweave.session import spread

REGIME_SWING_NS = 7_200_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _micros(column: str):
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's time zone (the
    difference of two zone-less times never goes through a zone)."""
    gap = f"({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(
        f"(extract(DAY FROM {gap}) * 86400L + extract(HOUR FROM {gap}) * 3600L + extract(MINUTE FROM {gap}) * 60L) * 1000000L"
        f" + CAST(extract(SECOND FROM {gap}) * 1000000 AS BIGINT)"
    )


def market_events(
    spark: SparkSession, folder: str, start_ns: int | None = None, end_ns: int | None = None
) -> DataFrame:
    """``events`` as market events. A time range is also given to the scan as a range on ``ts``."""
    raw = table(spark, folder, "events")
    if start_ns is not None:
        raw = raw.filter(F.col("ts") >= _ntz(start_ns))
    if end_ns is not None:
        raw = raw.filter(F.col("ts") <= _ntz(end_ns))
    return shape_events(raw)


def event_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """``events`` as a stream of market events: the same columns as the batch view."""
    schema = table(spark, folder, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    for key, value in options.items():
        reader = reader.option(key, value)
    return shape_events(reader.parquet(folder))


def shape_events(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.round(F.col("value") * 100).cast("bigint")
    base = raw.select(
        (_micros("ts") * 1000).alias("ts_exchange_ns"),
        F.expr("CAST(event_id % 3 AS INT)").alias("venue_id"),
        F.expr("CAST(user_id % 16 AS INT)").alias("symbol_id"),
        F.expr(
            "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 "
            "WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 END"
        ).alias("event_type"),
        k.alias("k"),
        cents.alias("cents"),
        F.col("event_id").cast("bigint").alias("seq"),
    )
    ts = F.col("ts_exchange_ns")
    return base.select(
        event_id(F.col("venue_id"), F.col("symbol_id"), F.col("seq"), ts).alias("event_id"),
        ts,
        (ts + 1_000_000).alias("ts_ingest_ns"),
        "venue_id",
        "symbol_id",
        "event_type",
        F.pmod("k", F.lit(2)).cast("int").alias("side"),
        (
            F.lit(10_000_000_000)
            + F.col("cents") * 500 * (F.pmod(int_div(ts, REGIME_SWING_NS), F.lit(4)) + 1)
        ).alias("price_fp"),
        ((F.col("k") + 1).cast("bigint") * 100_000_000).alias("qty_fp"),
        F.when(
            F.col("event_type") != 4,
            F.md5(F.concat_ws(":", F.col("symbol_id"), int_div(ts, DAY_NS))),
        ).alias("order_id_hash"),
        F.lit(None).cast("string").alias("participant_id_hash"),
        F.lit(0).alias("flags"),
        "seq",
    )


def _ntz(ns: int):
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + INTERVAL '{ns // 1_000_000_000}' SECOND") + F.expr(
        f"INTERVAL '{(ns % 1_000_000_000) // 1000 / 1_000_000:.6f}' SECOND"
    )


ME_SQL = """
me AS (
  SELECT left(sha256(unhex(printf('%08x%08x%016x%016x00000000', venue_id, symbol_id, seq, ts_exchange_ns))), 32) AS event_id,
         ts_exchange_ns, ts_exchange_ns + 1000000 AS ts_ingest_ns, venue_id, symbol_id, event_type,
         CAST(k % 2 AS INTEGER) AS side,
         10000000000 + cents * 500 * (1 + (ts_exchange_ns // 7200000000000) % 4) AS price_fp,
         (k + 1) * 100000000 AS qty_fp,
         CASE WHEN event_type <> 4 THEN md5(concat(symbol_id, ':', ts_exchange_ns // 86400000000000)) END AS order_id_hash,
         CAST(NULL AS VARCHAR) AS participant_id_hash, 0 AS flags, seq
  FROM (SELECT epoch_us(ts) * 1000 AS ts_exchange_ns, CAST(event_id % 3 AS INTEGER) AS venue_id,
               CAST(user_id % 16 AS INTEGER) AS symbol_id,
               CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2
                    WHEN 'purchase' THEN 3 WHEN 'click' THEN 4 END AS event_type,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
               CAST(round(value * 100) AS BIGINT) AS cents, event_id AS seq
        FROM events)
)"""


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as fills at scale 1e6: price 100.00 plus noise, quantity k+1, total order (ts, seq)."""
    events = market_events(spark, folder).filter(F.col("event_type") == 3)
    return events.select(
        "symbol_id",
        "venue_id",
        "side",
        int_div(F.col("price_fp"), 100).alias("price_fp"),
        int_div(F.col("qty_fp"), 100).alias("qty_fp"),
        F.col("ts_exchange_ns").alias("ts_ns"),
        "seq",
    )


FILLS_SQL = (
    ME_SQL
    + """,
fills AS (
  SELECT symbol_id, venue_id, side, price_fp // 100 AS price_fp, qty_fp // 100 AS qty_fp,
         ts_exchange_ns AS ts_ns, seq
  FROM me WHERE event_type = 3
)"""
)


def pnl_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Profit and loss steps in USD: every event's value, gains for even k and losses for odd k."""
    return market_events(spark, folder).select(
        "symbol_id",
        F.col("ts_exchange_ns").alias("ts_ns"),
        "seq",
        (
            (F.col("price_fp") - 10_000_000_000).cast("double")
            / F.lit(1_000_000.0)
            * F.when(F.col("side") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
        ).alias("pnl_usd"),
    )


PNL_SQL = (
    ME_SQL
    + """,
pnl AS (
  SELECT symbol_id, ts_exchange_ns AS ts_ns, seq,
         CAST(price_fp - 10000000000 AS DOUBLE) / 1000000.0 * CASE WHEN side = 0 THEN 1.0 ELSE -1.0 END AS pnl_usd
  FROM me
)"""
)


def order_intents(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as order intents: notional o_totalprice, symbol o_custkey, order (date, key)."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("symbol_id"),
        (_micros("o_orderdate") * 1000).alias("ts_ns"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.expr("CAST(o_orderkey % 4 AS BIGINT)").alias("lot"),
    ).select(
        "order_id",
        "symbol_id",
        "ts_ns",
        (F.col("cents") * 10_000).alias("price_fp"),
        ((F.col("lot")) * RISK_SCALE).alias("qty_fp"),
    )


INTENTS_SQL = """
intents AS (
  SELECT o_orderkey AS order_id, o_custkey AS symbol_id, epoch_us(o_orderdate) * 1000 AS ts_ns,
         CAST(round(o_totalprice * 100) AS BIGINT) * 10000 AS price_fp, (o_orderkey % 4) * 1000000 AS qty_fp
  FROM orders
)"""


def raw_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a raw venue frame. Quantity k+1 = 1..5 stands for the bad cases: no symbol,
    time as text, unknown kind, malformed price, and extra text digits (which must be cut off)."""
    return shape_frames(spread(market_events(spark, folder)))


def shape_frames(e: DataFrame) -> DataFrame:
    k = int_div(F.col("qty_fp"), 100_000_000) - 1
    ms = int_div(F.col("ts_exchange_ns"), 1_000_000).cast("string")
    time = F.when(k == 1, F.concat(F.lit('"'), ms, F.lit('"'))).otherwise(ms)
    price = F.when(k == 3, F.lit("abc")).otherwise(
        F.concat(
            int_div(F.col("price_fp"), 100_000_000),
            F.lit("."),
            F.lpad(F.pmod("price_fp", F.lit(100_000_000)).cast("string"), 8, "0"),
            F.when(k == 4, F.lit("99")).otherwise(F.lit("")),
        )
    )
    qty = (k + 1).cast("string")
    name = F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("S"), "symbol_id"))
    is_trade = F.col("event_type") == 3
    kind = F.when(k == 2, F.lit("ping")).when(is_trade, F.lit("trade")).otherwise(F.lit("depthUpdate"))
    level = F.format_string('["%s","%s"]', price, qty)
    gone = F.format_string('["%s","0.000"]', price)
    bid_side = F.col("side") == 0
    bids = F.when(bid_side, F.concat_ws(",", level, gone)).otherwise(gone)
    asks = F.when(bid_side, F.lit("")).otherwise(level)
    trade = F.format_string(
        '{"e":"%s","E":%s,"s":"%s","t":%d,"p":"%s","q":"%s","b":%d,"a":%d,"T":%s,"m":%s,"M":true}',
        kind, ms, name, F.col("seq"), price, qty, F.col("seq"), F.col("seq"), time,
        (F.col("side") == 1).cast("string"),
    )
    depth = F.format_string(
        '{"e":"%s","E":%s,"s":"%s","U":%d,"u":%d,"b":[%s],"a":[%s]}',
        kind, time, name, F.col("seq"), F.col("seq"), bids, asks,
    )
    return e.select(
        "venue_id",
        F.col("ts_ingest_ns").alias("received_at_ns"),
        F.col("seq").alias("frame_no"),
        F.when(is_trade, trade).otherwise(depth).alias("data"),
    )


def symbol_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """(venue, name, id, tick) of the symbols seen in ``events``; symbol 15 is left out, so its rows
    are unknown."""
    seen = market_events(spark, folder).select("venue_id", "symbol_id").distinct()
    return seen.filter("symbol_id <> 15").select(
        "venue_id", "symbol_id", F.concat(F.lit("S"), "symbol_id").alias("symbol_name")
    )


FRAMES_SQL = (
    ME_SQL
    + """,
fr AS (SELECT *, qty_fp // 100000000 - 1 AS k, CASE WHEN event_type = 3 THEN 'trade' ELSE 'depthUpdate' END AS route0 FROM me),
lv AS (
  SELECT venue_id, symbol_id, ts_ingest_ns AS received_at_ns, seq AS frame_no, route0 AS route, k, 0 AS pos,
         CASE WHEN event_type = 3 THEN side ELSE 0 END AS side, price_fp,
         CASE WHEN event_type = 3 OR side = 0 THEN qty_fp ELSE 0 END AS qty_fp, ts_exchange_ns // 1000000 * 1000000 AS ts_exchange_ns
  FROM fr WHERE k NOT IN (0, 1, 2)
  UNION ALL
  SELECT venue_id, symbol_id, ts_ingest_ns, seq, route0, k, 1, side, price_fp, CASE WHEN side = 0 THEN 0 ELSE qty_fp END, ts_exchange_ns // 1000000 * 1000000
  FROM fr WHERE k NOT IN (0, 1, 2) AND event_type <> 3
),
ne AS (
  SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY received_at_ns, frame_no, pos) AS nseq
  FROM lv WHERE k <> 3 AND symbol_id <> 15
),
norm AS (
  SELECT left(sha256(unhex(printf('%08x%08x%016x%016x00000000', venue_id, symbol_id, nseq, ts_exchange_ns))), 32) AS event_id,
         ts_exchange_ns, received_at_ns AS ts_ingest_ns, venue_id, symbol_id,
         CASE WHEN route = 'trade' THEN 3 WHEN qty_fp = 0 THEN 2 ELSE 1 END AS event_type, side, price_fp, qty_fp,
         CAST(NULL AS VARCHAR) AS order_id_hash, CAST(NULL AS VARCHAR) AS participant_id_hash, 0 AS flags, nseq AS seq
  FROM ne
)"""
)


# Control heads with the multipliers that spread their values over the rows.
HEADS = [
    ("place", 7, 100.0), ("modify", 13, 100.0), ("cancel", 29, 100.0), ("side", 19, 100.0), ("size", 23, 100.0),
    ("urgency", 3, 100.0), ("regime_uncertainty", 31, 100.0), ("adversarial_drift", 41, 50.0),
]


def model_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a mixing number z in 0..99 from which model outputs and states are worked out."""
    return with_mixing(spread(market_events(spark, folder)))


def with_mixing(events: DataFrame) -> DataFrame:
    k = int_div(F.col("qty_fp"), 100_000_000) - 1
    z = F.pmod(k * 17 + F.col("symbol_id") * 5, F.lit(100))
    return events.withColumns({"ts_ns": F.col("ts_exchange_ns"), "z": z.cast("bigint")})


def control_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Long control rows (seq, ts_ns, symbol_id, venue_id, z, head_name, value, confidence)."""
    return shape_controls(model_events(spark, folder))


def shape_controls(mixed: DataFrame) -> DataFrame:
    def head(name: str, times: int, scale: float):
        value = F.pmod(F.col("z") * times, F.lit(100)) / F.lit(scale)
        if name == "adversarial_drift":
            confidence = F.pmod(F.col("z") * 43, F.lit(100)) / F.lit(30.0)
        elif name == "regime_uncertainty":
            confidence = F.lit(0.4) + F.pmod(F.col("z") * 37, F.lit(100)) / F.lit(160.0)
        else:
            confidence = F.lit(0.9)
        return F.struct(F.lit(name).alias("head_name"), value.alias("value"), confidence.alias("confidence"))

    heads = F.array(*[head(*h) for h in HEADS])
    return mixed.select(
        "seq", "ts_ns", "symbol_id", "venue_id", "z", F.inline(heads)
    )


def policy_context(spark: SparkSession, folder: str) -> DataFrame:
    """Events with every column the policy reads: signals, gate decision, venue, risk."""
    return shape_context(control_rows(spark, folder))


def shape_context(controls: DataFrame) -> DataFrame:
    from bookweave.operators.gate import coherence_gate, signals_and_metrics

    keys = ["seq", "ts_ns", "symbol_id", "venue_id", "z"]
    both = signals_and_metrics(controls, keys)
    gated = coherence_gate(both.withColumn("regime", F.col("venue_id")))
    z = F.col("z")
    return gated.withColumns(
        {
            "partition_hash": F.lit("fallback-no-hash"),
            "kill_active": z == 3,
            "venue_halted": z == 5,
            "venue_healthy": z != 7,
            "slippage_bp": F.pmod(z, F.lit(10)) * F.lit(0.6),
            "order_rate_ratio": F.pmod(z * 3, F.lit(100)) / F.lit(100.0),
            "cancel_rate_ratio": F.pmod(z * 11, F.lit(100)) / F.lit(100.0),
        }
    )


_HEAD_COLUMNS = ", ".join(f"(z * {m} % 100) / {s}::DOUBLE AS {n}_v" for n, m, s in HEADS)
_SIGNALS = ", ".join(
    f"{n}_v AS {n if n in ('regime_uncertainty', 'adversarial_drift') else n + '_signal'}" for n, _, _ in HEADS
)
POLICY_SQL = (
    ME_SQL
    + f""",
mo AS (SELECT *, ts_exchange_ns AS ts_ns, ((qty_fp // 100000000 - 1) * 17 + symbol_id * 5) % 100 AS z FROM me),
hd AS (SELECT *, {_HEAD_COLUMNS}, 0.4::DOUBLE + (z * 37 % 100) / 160.0::DOUBLE AS mincut, (z * 43 % 100) / 30.0::DOUBLE AS cusum,
   (z * 41 % 100) / 50.0::DOUBLE AS drift, venue_id AS regime FROM mo),
th AS (SELECT *, CASE regime WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.5 ELSE 0.8 END AS t_m, CASE regime WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0 ELSE 0.5 END AS t_d,
   CASE regime WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 4.0 ELSE 2.0 END AS t_c FROM hd),
gt0 AS (SELECT *, list_filter([CASE WHEN mincut < t_m THEN printf('mincut %.6f < threshold %.1f', mincut, t_m) END,
   CASE WHEN drift > t_d THEN printf('drift %.6f > threshold %.1f', drift, t_d) END,
   CASE WHEN cusum > t_c THEN printf('cusum %.6f > threshold %.1f', cusum, t_c) END], lambda x: x IS NOT NULL) AS reasons FROM th),
ctx AS (SELECT *, {_SIGNALS}, len(reasons) = 0 AS allow_act, len(reasons) = 0 AS allow_write, CAST(floor(mincut * 1000) AS BIGINT) AS mincut_value,
   z = 3 AS kill_active, z = 5 AS venue_halted, z <> 7 AS venue_healthy, (z % 10) * 0.6::DOUBLE AS slippage_bp,
   (z * 3 % 100) / 100.0::DOUBLE AS order_rate_ratio, (z * 11 % 100) / 100.0::DOUBLE AS cancel_rate_ratio FROM gt0),
ru AS (SELECT *,
   CASE WHEN kill_active THEN 'kill_switch' WHEN venue_halted OR NOT venue_healthy THEN 'venue_health' WHEN NOT allow_act THEN 'coherence_gate'
        WHEN regime_uncertainty > 0.7 AND size_signal > 0.5 THEN 'regime_uncertainty' WHEN adversarial_drift > 0.6 THEN 'adversarial_drift'
        WHEN slippage_bp > 5 THEN 'slippage_drift' WHEN order_rate_ratio > 0.9 OR cancel_rate_ratio > 0.9 THEN 'rate_throttle'
        WHEN greatest(place_signal, modify_signal, cancel_signal) < 0.1 THEN 'no_signal' END AS rule,
   CASE WHEN urgency_signal > 0.8 THEN 'ioc' WHEN urgency_signal > 0.5 THEN 'marketable_limit' ELSE 'limit' END AS ot,
   CASE WHEN side_signal > 0.5 THEN 0 ELSE 1 END AS a_side,
   CAST(round(greatest(0.01, least(1.0, size_signal)) * 1000000) AS BIGINT) AS a_qty FROM ctx),
dc AS (SELECT *, CASE WHEN rule = 'rate_throttle' THEN 'throttle' WHEN rule IS NOT NULL THEN 'hold'
     WHEN place_signal >= modify_signal AND place_signal >= cancel_signal THEN 'place' WHEN modify_signal >= cancel_signal THEN 'modify' ELSE 'cancel' END AS action_type,
   CASE rule WHEN 'kill_switch' THEN 'Kill switch is active -- all trading halted'
     WHEN 'venue_health' THEN CASE WHEN venue_halted THEN 'Venue is halted' ELSE 'Venue is unhealthy' END
     WHEN 'coherence_gate' THEN 'Coherence blocked action: ' || array_to_string(reasons, '; ')
     WHEN 'regime_uncertainty' THEN printf('Regime uncertainty %.3f > 0.7 with upsize signal %.3f', regime_uncertainty, size_signal)
     WHEN 'adversarial_drift' THEN printf('Adversarial drift %.3f > 0.6', adversarial_drift)
     WHEN 'slippage_drift' THEN printf('Cumulative slippage %.2fbp > 5bp', slippage_bp)
     WHEN 'rate_throttle' THEN printf('Rate limit approaching: orders=%.2f, cancels=%.2f', order_rate_ratio, cancel_rate_ratio)
     WHEN 'no_signal' THEN 'All control signals below threshold' END AS detail FROM ru)"""
)


def graph_events(spark: SparkSession, folder: str) -> DataFrame:
    """Market events on a coarse price grid (so that levels are shared), with session markers and
    venue status rows in place of the two highest quantities."""
    k = int_div(F.col("qty_fp"), 100_000_000) - 1
    cents = int_div(F.col("price_fp") - 10_000_000_000, 500 * 2500)
    return market_events(spark, folder).withColumns(
        {
            "price_fp": F.lit(10_000_000_000) + cents * 1_000_000,
            "event_type": F.when(k == 98, 5).when(k == 99, 6).otherwise(F.col("event_type")),
            "flags": F.when(k == 99, F.col("symbol_id")).otherwise(F.lit(0)),
        }
    )


GRAPH_SQL = (
    ME_SQL
    + """,
ge AS (SELECT * REPLACE (10000000000 + ((price_fp - 10000000000) // 1250000) * 1000000 AS price_fp,
   CASE qty_fp WHEN 9900000000 THEN 5 WHEN 10000000000 THEN 6 ELSE event_type END AS event_type, CASE WHEN qty_fp = 10000000000 THEN symbol_id ELSE 0 END AS flags) FROM me),
g1 AS (SELECT *, 'pl:' || symbol_id || ':' || venue_id || ':' || price_fp || ':' || side AS level FROM ge),
g2 AS (SELECT *, CASE WHEN order_id_hash IS NOT NULL AND event_type < 4 THEN last_value(CASE WHEN event_type = 0 THEN {'e': event_id, 'l': level} END IGNORE NULLS)
     OVER (PARTITION BY order_id_hash, event_type < 4 ORDER BY ts_exchange_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS kn,
   sum(CASE WHEN event_type = 3 THEN qty_fp ELSE 0 END) OVER (PARTITION BY order_id_hash ORDER BY ts_exchange_ns, seq) AS tr FROM g1),
g3 AS (SELECT *, CASE WHEN event_type = 0 OR (event_type = 1 AND kn IS NOT NULL) THEN {'q': qty_fp, 's': tr} WHEN event_type = 2 AND kn IS NOT NULL THEN {'q': 0, 's': tr} END AS st FROM g2),
g4 AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY order_id_hash ORDER BY ts_exchange_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM g3),
lk AS (SELECT event_id, ts_exchange_ns, seq, venue_id, symbol_id, event_type, side, price_fp, qty_fp, order_id_hash, flags, level, kn.e AS order_event, kn.l AS order_level,
   CASE WHEN kn IS NOT NULL THEN CAST(greatest(0, ls.q - (tr - CASE WHEN event_type = 3 THEN qty_fp ELSE 0 END - ls.s)) AS BIGINT) END AS order_depth FROM g4),
lc AS (SELECT CASE WHEN event_type IN (0, 4) THEN level WHEN event_type IN (1, 2, 3) AND order_event IS NOT NULL THEN order_level END AS level_id, ts_exchange_ns, seq,
   CASE event_type WHEN 0 THEN qty_fp WHEN 1 THEN qty_fp - order_depth WHEN 2 THEN -order_depth WHEN 3 THEN -qty_fp END AS change,
   CASE WHEN event_type = 4 THEN qty_fp END AS snapshot, CASE WHEN event_type = 0 THEN qty_fp END AS refill, CASE event_type WHEN 2 THEN order_depth WHEN 3 THEN qty_fp END AS spent
   FROM lk WHERE event_type IN (0, 4) OR (event_type IN (1, 2, 3) AND order_event IS NOT NULL)),
l1 AS (SELECT *, sum(CASE WHEN snapshot IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY level_id ORDER BY ts_exchange_ns, seq) AS isl FROM lc),
l2 AS (SELECT *, sum(coalesce(snapshot, change)) OVER (PARTITION BY level_id, isl ORDER BY ts_exchange_ns, seq) AS c, sum(coalesce(sign(change), 0)) OVER (PARTITION BY level_id ORDER BY ts_exchange_ns, seq) AS qc FROM l1),
lh AS (SELECT *, CAST(c - least(0, min(c) OVER (PARTITION BY level_id, isl ORDER BY ts_exchange_ns, seq)) AS BIGINT) AS depth,
   CAST(qc - least(0, min(qc) OVER (PARTITION BY level_id ORDER BY ts_exchange_ns, seq)) AS BIGINT) AS queue_length FROM l2),
le AS (SELECT level_id, coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(refill::DOUBLE ORDER BY ts_exchange_ns, seq) FILTER (refill IS NOT NULL)), lambda a, x: 0.1 * x + 0.9 * a), 0) AS refill_rate,
   coalesce(list_reduce(list_prepend(0.0::DOUBLE, list(spent::DOUBLE ORDER BY ts_exchange_ns, seq) FILTER (spent IS NOT NULL)), lambda a, x: 0.1 * x + 0.9 * a), 0) AS depletion_rate FROM lc GROUP BY 1),
ls AS (SELECT level_id, arg_max(depth, seq) AS depth, arg_max(queue_length, seq) AS queue_length, min(ts_exchange_ns) AS created_at_ns, max(ts_exchange_ns) AS updated_at_ns,
   split_part(level_id, ':', 2)::INT AS symbol_id, split_part(level_id, ':', 3)::INT AS venue_id, split_part(level_id, ':', 4)::BIGINT AS price_fp, split_part(level_id, ':', 5)::INT AS side FROM lh GROUP BY 1),
os AS (SELECT CASE WHEN event_type = 0 THEN event_id ELSE order_event END AS order_event,
   arg_max(CASE WHEN event_type < 2 THEN qty_fp WHEN event_type = 2 THEN 0 ELSE greatest(0, order_depth - qty_fp) END, seq) AS depth, count(*) FILTER (event_type = 1) AS modify_count,
   max(CASE WHEN event_type = 2 THEN 1 ELSE 0 END) AS cancel_hazard, max(CASE WHEN event_type = 3 THEN 1 ELSE 0 END) AS fill_hazard, min(ts_exchange_ns) AS created_at_ns, max(ts_exchange_ns) AS updated_at_ns
   FROM lk WHERE event_type = 0 OR order_event IS NOT NULL GROUP BY 1),
vs AS (SELECT venue_id, arg_max(flags, seq) AS flags, max(ts_exchange_ns) AS updated_at_ns FROM lk WHERE event_type = 6 GROUP BY 1),
nodes AS (
  SELECT 'sym:' || symbol_id AS id, 0 AS kind, min(ts_exchange_ns) AS created_at_ns, min(ts_exchange_ns) AS updated_at_ns, 0::DOUBLE AS depth, 0::DOUBLE AS cancel FROM lk WHERE event_type IN (0, 3, 4, 5) GROUP BY symbol_id
  UNION ALL SELECT 'ven:' || l.venue_id, 1, min(ts_exchange_ns), coalesce(max(v.updated_at_ns), min(ts_exchange_ns)), 0, 0 FROM lk l LEFT JOIN vs v ON v.venue_id = l.venue_id WHERE event_type IN (0, 3, 4, 6) GROUP BY l.venue_id
  UNION ALL SELECT level_id, 2, created_at_ns, updated_at_ns, depth, 0 FROM ls
  UNION ALL SELECT 'ord:' || order_event, 3, created_at_ns, updated_at_ns, depth, cancel_hazard FROM os
  UNION ALL SELECT 'ev:' || event_id, 5, ts_exchange_ns, ts_exchange_ns, 0, 0 FROM lk WHERE event_type <= 4
  UNION ALL SELECT 'trd:' || event_id, 4, ts_exchange_ns, ts_exchange_ns, qty_fp, 0 FROM lk WHERE event_type = 3
  UNION ALL SELECT 'tb:' || event_id, 7, ts_exchange_ns, ts_exchange_ns, 0, 0 FROM lk WHERE event_type = 5
  UNION ALL SELECT 'rg:' || event_id, 8, ts_exchange_ns, ts_exchange_ns, 0, 0 FROM lk WHERE event_type = 5),
edges AS (SELECT 'e:' || kind || ':' || event_id AS id, kind, source_id, target_id, event_type, ts_exchange_ns AS created_at_ns FROM (
  SELECT event_id, event_type, ts_exchange_ns, 0 AS kind, 'ord:' || event_id AS source_id, level AS target_id FROM lk WHERE event_type = 0
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 2, 'ev:' || event_id, CASE event_type WHEN 0 THEN 'ord:' || event_id WHEN 3 THEN 'trd:' || event_id ELSE level END FROM lk WHERE event_type IN (0, 3, 4)
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 6, CASE event_type WHEN 0 THEN 'ord:' WHEN 3 THEN 'trd:' ELSE 'tb:' END || event_id, 'sym:' || symbol_id FROM lk WHERE event_type IN (0, 3, 5)
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 7, CASE event_type WHEN 0 THEN 'ord:' ELSE 'trd:' END || event_id, 'ven:' || venue_id FROM lk WHERE event_type IN (0, 3)
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 4, 'ev:' || event_id, 'ord:' || order_event FROM lk WHERE event_type = 1 AND order_event IS NOT NULL
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 5, 'ord:' || order_event, 'ev:' || event_id FROM lk WHERE event_type = 2 AND order_event IS NOT NULL
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 3, 'trd:' || event_id, 'ord:' || order_event FROM lk WHERE event_type = 3 AND order_event IS NOT NULL
  UNION ALL SELECT event_id, event_type, ts_exchange_ns, 10, 'tb:' || event_id, 'rg:' || event_id FROM lk WHERE event_type = 5))"""
)
