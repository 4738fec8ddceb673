"""Event-log quality: counts, coverage, sequence gaps, clock order and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import bucket_start, decode, int_div, ns_to_ntz
from bookweave.operators.ordered import lag_of, running, unwrap
from bookweave.schemas import EVENT_TYPES, HOUR_NS


def event_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n"))


def count_by_symbol(events: DataFrame) -> DataFrame:
    return events.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n")).orderBy("symbol_id")


def count_by_type(events: DataFrame) -> DataFrame:
    """Counts per event type with the decoded name; the decode runs on the few counted rows."""
    counted = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("type_name", decode(F.col("event_type"), EVENT_TYPES)).orderBy("event_type")


def hour_label(ts_ns: Column) -> Column:
    return F.date_format(ns_to_ntz(ts_ns), "yyyy-MM-dd HH:00")


def count_by_hour(events: DataFrame) -> DataFrame:
    """Counts per hour, grouped on the integer hour so only the result rows are formatted."""
    hours = events.groupBy(bucket_start(F.col("ts_exchange_ns"), HOUR_NS).alias("hour_ns")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return hours.select(hour_label(F.col("hour_ns")).alias("hour"), "n").orderBy("hour")


def hours_of_coverage(events: DataFrame, approximate: bool = False) -> DataFrame:
    hour = int_div(F.col("ts_exchange_ns"), HOUR_NS)
    count = F.approx_count_distinct(hour) if approximate else F.count_distinct(hour)
    return events.agg(count.alias("hours"))


def distinct_symbols(events: DataFrame) -> DataFrame:
    return events.select("symbol_id").distinct().orderBy("symbol_id")


def _with_previous(events: DataFrame, order: list[str]) -> DataFrame:
    slim = events.select("symbol_id", "seq", "ts_exchange_ns", "event_id")
    with_lag = running(
        slim,
        ["symbol_id"],
        order,
        prev_seq=lag_of(F.col("seq")),
        prev_ts=lag_of(F.col("ts_exchange_ns")),
    )
    return unwrap(with_lag, "prev_seq", "prev_ts")


SEQ_ORDER = ["seq", "ts_exchange_ns", "event_id"]


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Per symbol in seq order: rows whose seq jumps by more than one."""
    rows = _with_previous(events, SEQ_ORDER)
    return rows.filter(F.col("seq") - F.col("prev_seq") > 1).select(
        "symbol_id",
        (F.col("prev_seq") + 1).alias("expected_seq"),
        F.col("seq").alias("actual_seq"),
        "ts_exchange_ns",
    )


def clock_violations(events: DataFrame) -> DataFrame:
    """Per symbol in seq order: rows whose exchange time runs backwards."""
    rows = _with_previous(events, SEQ_ORDER)
    return rows.filter(F.col("ts_exchange_ns") < F.col("prev_ts")).select(
        "symbol_id", "seq", "prev_ts", "ts_exchange_ns"
    )


def quality_verdict(events: DataFrame, max_rate: float = 0.01) -> DataFrame:
    """Critical issues as rows; empty when the log is healthy. One ordered pass gives all counts."""
    rows = _with_previous(events, SEQ_ORDER)
    totals = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("seq") - F.col("prev_seq") > 1).alias("gaps"),
        F.count_if(F.col("ts_exchange_ns") < F.col("prev_ts")).alias("backwards"),
    )
    safe = F.greatest(F.col("total"), F.lit(1)).cast("double")
    none = F.col("total") == 0

    def issue(name: str, count: Column, hit: Column) -> Column:
        return F.struct(
            F.lit(name).alias("issue"), count.cast("bigint").alias("n"), F.coalesce(hit, F.lit(False)).alias("hit")
        )

    issues = F.array(
        issue("sequence_gap_rate", F.col("gaps"), ~none & (F.col("gaps") / safe > max_rate)),
        issue("no_events", F.lit(0), none),
        issue("monotonicity_rate", F.col("backwards"), ~none & (F.col("backwards") / safe > max_rate)),
    )
    return totals.select(F.inline(issues)).filter("hit").select("issue", "n")


def ingest_statistics(events: DataFrame) -> DataFrame:
    """Totals per feed (venue): events, gaps per (venue, symbol), malformed rows, last time."""
    malformed = F.col("price_fp").isNull() | F.col("qty_fp").isNull() | F.col("event_type").isNull()
    slim = events.select(
        "venue_id", "symbol_id", "seq", "ts_exchange_ns", malformed.alias("malformed")
    )
    rows = unwrap(
        running(slim, ["venue_id", "symbol_id"], ["ts_exchange_ns", "seq"], prev=lag_of(F.col("seq"))),
        "prev",
    )
    return rows.groupBy("venue_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("seq") != F.col("prev") + 1).alias("gaps"),
        F.count_if("malformed").alias("malformed"),
        F.max("ts_exchange_ns").alias("last_ts_ns"),
    )


def throughput(events: DataFrame, interval_s: int) -> DataFrame:
    """Events per second in tumbling intervals."""
    width = interval_s * 1_000_000_000
    return events.groupBy(
        bucket_start(F.col("ts_exchange_ns"), width).alias("interval_start_ns")
    ).agg((F.count(F.lit(1)) / F.lit(float(interval_s))).alias("events_per_s"))
