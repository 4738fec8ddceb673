"""Ingest queries: ``events`` re-told as raw venue frames and parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bookweave.functions.scalars import decimal_text_to_fixed, fixed_to_double, int_div, ms_to_ns, ns_to_ntz
from bookweave.operators import ingest as I
from bookweave.plans.catalog import query
from bookweave.schemas import DAY_NS, INGEST_SCALE, RISK_SCALE
from bookweave.session import checkpoint_dir
from bookweave.sources.driver_tables import FRAMES_SQL, ME_SQL, market_events, raw_frames, symbol_dimension
from bookweave.sources.event_log import TieredLog
from bookweave.sources.frames import frame_time_ms

ME = f"WITH {ME_SQL} "
FR = f"WITH {FRAMES_SQL} "
EVENT_COLS = ", ".join(I.EVENT_COLUMNS)


@query("frame_times", "A2", FR + "SELECT seq AS frame_no, CASE WHEN k = 1 AND event_type <> 3 THEN NULL ELSE ts_exchange_ns // 1000000 END AS event_ms FROM fr")
def _(spark, d):
    return raw_frames(spark, d).select("frame_no", frame_time_ms(F.try_parse_json("data")).alias("event_ms"))


@query(
    "frame_routes",
    "B1 B2 B3",
    FR
    + """SELECT seq AS frame_no, CASE WHEN k <> 2 THEN route0 END AS route,
 CASE WHEN k = 0 THEN 'missing symbol' WHEN k = 1 AND event_type = 3 THEN 'missing trade time' WHEN k = 1 THEN 'missing event time' END AS reason FROM fr""",
)
def _(spark, d):
    return I.parse_frames(raw_frames(spark, d)).select("frame_no", "route", "reason")


@query(
    "rejected_frame_counts",
    "B2 B3",
    FR
    + """SELECT route0 AS route, CASE WHEN k = 0 THEN 'missing symbol' WHEN event_type = 3 THEN 'missing trade time' ELSE 'missing event time' END AS reason,
 count(*) AS n FROM fr WHERE k IN (0, 1) GROUP BY 1, 2""",
)
def _(spark, d):
    bad = I.rejected_frames(I.parse_frames(raw_frames(spark, d)))
    return bad.groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "book_levels",
    "B4 G1",
    FR + "SELECT frame_no, pos, route, side, ts_exchange_ns, 'S' || symbol_id AS symbol_name FROM lv",
)
def _(spark, d):
    return I.flatten_frames(I.parse_frames(raw_frames(spark, d))).select(
        "frame_no", "pos", "route", "side", "ts_exchange_ns", "symbol_name"
    )


@query("text_to_fixed_point", "B7", FR + "SELECT frame_no, pos, CASE WHEN k <> 3 THEN price_fp END AS price_fp, qty_fp FROM lv")
def _(spark, d):
    rows = I.flatten_frames(I.parse_frames(raw_frames(spark, d)))
    return rows.select(
        "frame_no",
        "pos",
        decimal_text_to_fixed(F.col("price")).alias("price_fp"),
        decimal_text_to_fixed(F.col("qty")).alias("qty_fp"),
    )


@query("normalized_events", "B4 B5 B6 B8 C1 E4 L4", FR + f"SELECT {EVENT_COLS} FROM norm")
def _(spark, d):
    return I.normalize(raw_frames(spark, d), symbol_dimension(spark, d))


@query("normalized_trades", "B6", FR + f"SELECT {EVENT_COLS} FROM norm WHERE event_type = 3")
def _(spark, d):
    return I.normalize(raw_frames(spark, d), symbol_dimension(spark, d)).filter("event_type = 3")


@query(
    "normalized_per_symbol",
    "E4 B8",
    FR
    + """, x AS (SELECT *, row_number() OVER (PARTITION BY venue_id, symbol_id ORDER BY received_at_ns, frame_no, pos) AS s FROM ne)
 SELECT venue_id, symbol_id, s AS seq, ts_exchange_ns, left(sha256(unhex(printf('%08x%08x%016x%016x00000000', venue_id, symbol_id, s, ts_exchange_ns))), 32) AS event_id FROM x""",
)
def _(spark, d):
    return I.normalize(raw_frames(spark, d), symbol_dimension(spark, d), per="symbol").select(
        "venue_id", "symbol_id", "seq", "ts_exchange_ns", "event_id"
    )


@query(
    "unknown_symbol_counts",
    "C1",
    FR + "SELECT venue_id, 'S' || symbol_id AS symbol_name, count(*) AS n FROM lv WHERE symbol_id = 15 GROUP BY 1, 2",
)
def _(spark, d):
    rows = I.flatten_frames(I.parse_frames(raw_frames(spark, d)))
    return I.unknown_symbols(rows, symbol_dimension(spark, d))


@query("event_ids", "B8", ME + "SELECT seq, event_id FROM me")
def _(spark, d):
    return market_events(spark, d).select("seq", "event_id")


@query(
    "fixed_to_decimal",
    "B9",
    ME + "SELECT seq, price_fp / 1e8 AS price, (price_fp // 100) / 1e6 AS price_risk, qty_fp / 1e8 AS qty FROM me",
)
def _(spark, d):
    return market_events(spark, d).select(
        "seq",
        fixed_to_double(F.col("price_fp"), INGEST_SCALE).alias("price"),
        fixed_to_double(int_div(F.col("price_fp"), 100), RISK_SCALE).alias("price_risk"),
        fixed_to_double(F.col("qty_fp"), INGEST_SCALE).alias("qty"),
    )


@query(
    "time_scaling",
    "H6",
    ME
    + "SELECT seq, strftime(make_timestamp(ts_exchange_ns // 1000), '%Y-%m-%d %H:%M:%S.%f') AS at, ts_exchange_ns // 1000000 * 1000000 AS ms_ns FROM me",
)
def _(spark, d):
    return market_events(spark, d).select(
        "seq",
        F.date_format(ns_to_ntz(F.col("ts_exchange_ns")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        ms_to_ns(int_div(F.col("ts_exchange_ns"), 1_000_000)).alias("ms_ns"),
    )


# a ten-day range of the thirty days in the data, in ns
T0, T1 = 1_704_499_200_000_000_000, 1_705_363_200_000_000_000


@query(
    "events_by_symbol_and_time",
    "B10 F1",
    ME + f"SELECT {EVENT_COLS} FROM me WHERE symbol_id = 3 AND ts_exchange_ns >= {T0} AND ts_exchange_ns < {T1}",
)
def _(spark, d):
    return I.events_by(market_events(spark, d, T0, T1), "symbol_id", 3, T0, T1)


@query(
    "events_by_venue_and_time",
    "B11 F1",
    ME + f"SELECT {EVENT_COLS} FROM me WHERE venue_id = 1 AND ts_exchange_ns >= {T0} AND ts_exchange_ns < {T1}",
)
def _(spark, d):
    return I.events_by(market_events(spark, d, T0, T1), "venue_id", 1, T0, T1)


@query("canonical_order", "F1", ME + "SELECT ts_exchange_ns, seq, event_id FROM me")
def _(spark, d):
    return I.canonical_order(market_events(spark, d).select("ts_exchange_ns", "seq", "event_id"))


@query("conformed_events", "B16", ME + f"SELECT {EVENT_COLS} FROM me")
def _(spark, d):
    text = market_events(spark, d)
    return I.conform(text.select(*[F.col(c).cast("string").alias(c) for c in text.columns]), "market_events")


@query(
    "defaulted_events",
    "B17",
    ME
    + """SELECT event_id, CASE WHEN side = 0 THEN 0 ELSE seq END AS seq, 0 AS flags,
 CASE WHEN event_type = 4 THEN 42 ELSE ts_exchange_ns END AS ts_exchange_ns, ts_ingest_ns FROM me""",
)
def _(spark, d):
    partial = market_events(spark, d).withColumns(
        {
            "seq": F.when(F.col("side") != 0, F.col("seq")),
            "flags": F.lit(None).cast("int"),
            "ts_exchange_ns": F.when(F.col("event_type") != 4, F.col("ts_exchange_ns")),
        }
    )
    return I.with_defaults(partial, 42).select("event_id", "seq", "flags", "ts_exchange_ns", "ts_ingest_ns")


@query(
    "hourly_partitions",
    "A4",
    ME
    + """SELECT event_id, b AS bucket_start_ns, b + 3600000000000 AS bucket_end_ns, 'nt_event_log_' || b AS partition_name
 FROM (SELECT event_id, ts_exchange_ns // 3600000000000 * 3600000000000 AS b FROM me)""",
)
def _(spark, d):
    return I.hourly_buckets(market_events(spark, d)).select(
        "event_id", "bucket_start_ns", "bucket_end_ns", "partition_name"
    )


@query(
    "daily_partitions",
    "A5",
    ME
    + """SELECT event_id, b AS bucket_start_ns, b + 86400000000000 AS bucket_end_ns, 'nt_segments_' || b AS partition_name
 FROM (SELECT event_id, ts_exchange_ns // 86400000000000 * 86400000000000 AS b FROM me)""",
)
def _(spark, d):
    return I.daily_buckets(market_events(spark, d), "ts_exchange_ns").select(
        "event_id", "bucket_start_ns", "bucket_end_ns", "partition_name"
    )


@query(
    "partition_registry",
    "A6",
    ME
    + """SELECT 'nt_event_log' AS table_name, 'nt_event_log_' || b AS partition_name, b AS range_start_ns, b + 3600000000000 AS range_end_ns,
 count(*) AS row_count, 'hot' AS tier FROM (SELECT ts_exchange_ns // 3600000000000 * 3600000000000 AS b FROM me) GROUP BY b""",
)
def _(spark, d):
    return I.partition_registry(I.hourly_buckets(market_events(spark, d)), "nt_event_log")


NOW = 1_706_659_200_000_000_000  # 2024-01-31


@query(
    "retention_tiers",
    "A7",
    ME
    + f"""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN a < 14400000000000 THEN 'hot' WHEN a < 2592000000000000 THEN 'warm'
 WHEN a < 31536000000000000 THEN 'cold' ELSE 'purge' END AS tier
 FROM (SELECT {NOW} - ts_exchange_ns + seq % 2 * 31536000000000000 AS a FROM me)) GROUP BY 1""",
)
def _(spark, d):
    aged = market_events(spark, d).withColumn(
        "ts", F.col("ts_exchange_ns") - F.pmod("seq", F.lit(2)) * 31_536_000_000_000_000
    )
    return I.with_tier(aged, "ts", NOW).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


AGED = [NOW, NOW + 10 * DAY_NS, NOW + 355 * DAY_NS]  # the last ages that the log is brought to


@query(
    "tier_moves",
    "A7",
    ME
    + f"""SELECT aged_at, hour_bucket, a AS from_tier, b AS to_tier FROM (SELECT aged_at, hour_bucket, """
    + ", ".join(f"CASE WHEN {t} - hour_bucket - 3599999999999 < 14400000000000 THEN 'hot' WHEN {t} - hour_bucket - 3599999999999 < 2592000000000000 THEN 'warm' WHEN {t} - hour_bucket - 3599999999999 < 31536000000000000 THEN 'cold' ELSE 'purge' END AS {n}" for t, n in [("aged_before", "a"), ("aged_at", "b")])
    + f""" FROM (SELECT DISTINCT ts_exchange_ns // 3600000000000 * 3600000000000 AS hour_bucket FROM me), (VALUES (0, {AGED[0]}), ({AGED[0]}, {AGED[1]}), ({AGED[1]}, {AGED[2]})) AS t(aged_before, aged_at)) WHERE a <> b""",
)
def _(spark, d):
    """The events as a log in tiers, brought to three ages; what each of them moved."""
    log = TieredLog(spark, f"{checkpoint_dir(spark)}/tiers-{uuid.uuid4().hex}")
    log.append(market_events(spark, d))
    moves = [(at, *move) for at in AGED for move in log.age(at)]
    return spark.createDataFrame(moves, "aged_at bigint, hour_bucket bigint, from_tier string, to_tier string")


@query(
    "insert_ignore",
    "A3 G5",
    ME + f"SELECT {EVENT_COLS} FROM me WHERE side <> 0",
)
def _(spark, d):
    """The log holds one side of the book; the batch is the whole table sent twice."""
    events = market_events(spark, d)
    resent = events.withColumn("ts_ingest_ns", F.col("ts_ingest_ns") + 5)
    return I.new_events(events.filter("side = 0"), events.unionByName(resent))


@query("merged_feeds", "G2 F1", ME + "SELECT venue_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM me GROUP BY 1")
def _(spark, d):
    events = market_events(spark, d)
    feeds = [events.filter(F.col("venue_id") == v) for v in range(3)]
    return I.merge_feeds(*feeds).groupBy("venue_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


SEQUENCER = """, g AS (SELECT *, lag(seq) OVER (PARTITION BY venue_id, symbol_id ORDER BY ts_ingest_ns, event_id) AS ps FROM (
  SELECT venue_id, symbol_id, ts_ingest_ns, event_id, qty_fp // 100000000 + seq AS seq FROM me))
 SELECT venue_id, symbol_id, ps + 1 AS expected_seq, seq AS received_seq,
 CASE WHEN seq - ps - 1 > 100 THEN 'large_gap' WHEN seq - ps - 1 > 0 THEN 'gap' ELSE 'out_of_order' END AS gap_class FROM g WHERE seq <> ps + 1"""


@query("sequencer_gaps", "E3", ME + SEQUENCER)
def _(spark, d):
    events = market_events(spark, d).withColumn("seq", F.col("seq") + int_div(F.col("qty_fp"), 100_000_000))
    return I.sequencer(events, ["ts_ingest_ns", "event_id"])


@query(
    "sequencer_gaps_after_reset",
    "E3",
    ME
    + """, e AS (SELECT *, sum(CASE WHEN event_type = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY venue_id, symbol_id ORDER BY ts_ingest_ns, event_id) AS epoch FROM me),
 g AS (SELECT *, lag(seq) OVER (PARTITION BY venue_id, symbol_id, epoch ORDER BY ts_ingest_ns, event_id) AS ps FROM e)
 SELECT venue_id, symbol_id, ps + 1 AS expected_seq, seq AS received_seq,
 CASE WHEN seq - ps - 1 > 100 THEN 'large_gap' WHEN seq - ps - 1 > 0 THEN 'gap' ELSE 'out_of_order' END AS gap_class FROM g WHERE seq <> ps + 1""",
)
def _(spark, d):
    return I.sequencer(market_events(spark, d), ["ts_ingest_ns", "event_id"], reset=F.col("event_type") == 4)


@query(
    "reorder_release",
    "K2 K4",
    ME
    + """, a AS (SELECT event_id, ts_exchange_ns, ts_exchange_ns + qty_fp * 100 AS arrival FROM me),
 w AS (SELECT *, row_number() OVER o AS step, max(ts_exchange_ns) OVER o AS newest FROM a WINDOW o AS (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)),
 reached AS (SELECT newest, min(step) AS first_step FROM w GROUP BY 1),
 r AS (SELECT w.*, greatest(step, coalesce(first_step, 1099511627776)) AS gone FROM w ASOF LEFT JOIN reached ON w.ts_exchange_ns + 300000000000 <= reached.newest),
 g AS (SELECT gone, max(max(ts_exchange_ns)) OVER (ORDER BY gone) AS latest FROM r GROUP BY 1)
 SELECT event_id, r.newest - 300000000000 AS cutoff_ns, coalesce(ts_exchange_ns < g.latest, false) AS late,
  row_number() OVER (ORDER BY r.gone, ts_exchange_ns, step) AS release_no FROM r ASOF LEFT JOIN g ON r.step > g.gone""",
)
def _(spark, d):
    """Arrival is delayed by the quantity, so events overtake each other; tolerance five minutes."""
    events = market_events(spark, d).withColumn("arrival", F.col("ts_exchange_ns") + F.col("qty_fp") * 100)
    return I.release_times(
        events.select("event_id", "ts_exchange_ns", "arrival"), ["arrival", "event_id"], 300_000_000_000
    ).select("event_id", "cutoff_ns", "late", "release_no")
