"""Quality queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookweave.operators import quality as Q
from bookweave.plans.catalog import query
from bookweave.sources.driver_tables import ME_SQL, market_events

WITH = f"WITH {ME_SQL} "


@query("event_count", "D1", WITH + "SELECT count(*) AS n FROM me")
def _(spark, d):
    return Q.event_count(market_events(spark, d))


@query("count_by_symbol", "D2", WITH + "SELECT symbol_id, count(*) AS n FROM me GROUP BY 1")
def _(spark, d):
    return Q.count_by_symbol(market_events(spark, d))


@query(
    "count_by_type",
    "D3 B15",
    WITH
    + """SELECT event_type, count(*) AS n, CASE event_type WHEN 0 THEN 'NewOrder' WHEN 1 THEN 'ModifyOrder'
 WHEN 2 THEN 'CancelOrder' WHEN 3 THEN 'Trade' WHEN 4 THEN 'BookSnapshot' ELSE 'Unknown(' || event_type || ')' END AS type_name
 FROM me GROUP BY 1""",
)
def _(spark, d):
    return Q.count_by_type(market_events(spark, d))


@query(
    "type_names",
    "B15",
    WITH
    + """, t AS (SELECT seq, CAST(seq % 9 AS INTEGER) AS code FROM me)
 SELECT seq, code, coalesce(['NewOrder','ModifyOrder','CancelOrder','Trade','BookSnapshot','SessionMarker','VenueStatus'][code + 1],
   'Unknown(' || code || ')') AS type_name FROM t""",
)
def _(spark, d):
    from bookweave.functions.scalars import decode
    from bookweave.schemas import EVENT_TYPES

    codes = market_events(spark, d).select("seq", F.pmod("seq", F.lit(9)).cast("int").alias("code"))
    return codes.withColumn("type_name", decode(F.col("code"), EVENT_TYPES))


@query(
    "count_by_hour",
    "D4",
    WITH
    + "SELECT strftime(make_timestamp(ts_exchange_ns // 1000), '%Y-%m-%d %H:00') AS hour, count(*) AS n FROM me GROUP BY 1",
)
def _(spark, d):
    return Q.count_by_hour(market_events(spark, d))


@query("hours_of_coverage", "D5", WITH + "SELECT count(DISTINCT ts_exchange_ns // 3600000000000) AS hours FROM me")
def _(spark, d):
    return Q.hours_of_coverage(market_events(spark, d))


@query("hours_of_coverage_approx", "D5")
def _(spark, d):
    return Q.hours_of_coverage(market_events(spark, d), approximate=True)


@query("distinct_symbols", "D6", WITH + "SELECT DISTINCT symbol_id FROM me")
def _(spark, d):
    return Q.distinct_symbols(market_events(spark, d))


GAPS = """, g AS (SELECT *, lag(seq) OVER w AS ps, lag(ts_exchange_ns) OVER w AS pt FROM me
 WINDOW w AS (PARTITION BY symbol_id ORDER BY seq, ts_exchange_ns)) """


@query(
    "sequence_gaps",
    "E1",
    WITH + GAPS + "SELECT symbol_id, ps + 1 AS expected_seq, seq AS actual_seq, ts_exchange_ns FROM g WHERE seq - ps > 1",
)
def _(spark, d):
    return Q.sequence_gaps(market_events(spark, d))


# seq re-read as the quantity order gives a log whose clock does run backwards
BACK_SQL = """, g AS (SELECT symbol_id, q AS seq, ts_exchange_ns, lag(ts_exchange_ns) OVER (PARTITION BY symbol_id ORDER BY q, ts_exchange_ns) AS prev_ts
 FROM (SELECT *, qty_fp // 100000000 AS q FROM me)) """


@query(
    "clock_violations",
    "E2",
    WITH + BACK_SQL + "SELECT symbol_id, seq, prev_ts, ts_exchange_ns FROM g WHERE ts_exchange_ns < prev_ts",
)
def _(spark, d):
    from bookweave.functions.scalars import int_div

    events = market_events(spark, d).withColumn("seq", int_div(F.col("qty_fp"), 100_000_000))
    return Q.clock_violations(events)


@query(
    "quality_verdict",
    "D7",
    WITH
    + GAPS
    + """, t AS (SELECT count(*) AS total, count(*) FILTER (seq - ps > 1) AS gaps, count(*) FILTER (ts_exchange_ns < pt) AS back FROM g)
 SELECT 'sequence_gap_rate' AS issue, gaps AS n FROM t WHERE total > 0 AND gaps / total::DOUBLE > 0.01
 UNION ALL SELECT 'no_events', 0 FROM t WHERE total = 0
 UNION ALL SELECT 'monotonicity_rate', back FROM t WHERE total > 0 AND back / total::DOUBLE > 0.01""",
)
def _(spark, d):
    return Q.quality_verdict(market_events(spark, d))


@query(
    "ingest_statistics",
    "D8",
    WITH
    + """, g AS (SELECT *, lag(seq) OVER (PARTITION BY venue_id, symbol_id ORDER BY ts_exchange_ns, seq) AS ps FROM me)
 SELECT venue_id, count(*) AS total_events, count(*) FILTER (seq <> ps + 1) AS gaps,
   count(*) FILTER (price_fp IS NULL OR qty_fp IS NULL OR event_type IS NULL) AS malformed, max(ts_exchange_ns) AS last_ts_ns FROM g GROUP BY 1""",
)
def _(spark, d):
    return Q.ingest_statistics(market_events(spark, d))


@query(
    "throughput",
    "D9",
    WITH
    + "SELECT ts_exchange_ns // 3600000000000 * 3600000000000 AS interval_start_ns, count(*) / 3600.0::DOUBLE AS events_per_s FROM me GROUP BY 1",
)
def _(spark, d):
    return Q.throughput(market_events(spark, d), 3600)
