"""Raw frames to market events: validation, flattening, sequencing, ordering and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import (
    bucket_start,
    decimal_text_to_fixed,
    event_id,
    ms_to_ns,
)
from bookweave.operators.ordered import count_of, lag_of, max_of, min_of, row_numbers, running, sum_of, unwrap
from bookweave.schemas import DAY_NS, EVENT_LOG_PREFIX, HOUR_NS, SEGMENT_PREFIX, table_schema
from bookweave.session import cut_lineage
from bookweave.sources.frames import is_number, kind_of, parser_for

EVENT_COLUMNS = [
    "event_id", "ts_exchange_ns", "ts_ingest_ns", "venue_id", "symbol_id", "event_type", "side",
    "price_fp", "qty_fp", "order_id_hash", "participant_id_hash", "flags", "seq",
]


def _is_text(message: Column, path: str) -> Column:
    return F.coalesce(kind_of(message, path) == "STRING", F.lit(False))


def _is_array(message: Column, path: str) -> Column:
    return F.coalesce(kind_of(message, path).startswith("ARRAY"), F.lit(False))


def _first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(~ok, F.lit(reason)) for ok, reason in checks])


def depth_reason(message: Column) -> Column:
    """First reason why a depth update is not valid, null when it is."""
    text = F.try_variant_get(message, "$.s", "string")
    return _first_reason(
        (F.coalesce(F.try_variant_get(message, "$.e", "string") == "depthUpdate", F.lit(False)), "wrong event type"),
        (is_number(message, "$.E"), "missing event time"),
        (_is_text(message, "$.s") & (F.length(text) > 0), "missing symbol"),
        (_is_array(message, "$.b"), "missing bids array"),
        (_is_array(message, "$.a"), "missing asks array"),
    )


def trade_reason(message: Column) -> Column:
    """First reason why a trade is not valid, null when it is."""
    text = F.try_variant_get(message, "$.s", "string")
    return _first_reason(
        (F.coalesce(F.try_variant_get(message, "$.e", "string") == "trade", F.lit(False)), "wrong event type"),
        (is_number(message, "$.T"), "missing trade time"),
        (_is_text(message, "$.s") & (F.length(text) > 0), "missing symbol"),
        (_is_text(message, "$.p"), "missing price"),
        (_is_text(message, "$.q"), "missing quantity"),
        (F.coalesce(kind_of(message, "$.m") == "BOOLEAN", F.lit(False)), "missing maker flag"),
    )


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add an expensive column so that it is worked out once per row: a one-element generator keeps
    the optimizer from copying the expression into every later use of the column."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_frames(frames: DataFrame, feed: str = "default") -> DataFrame:
    """Frame text parsed once, with its route (``depthUpdate``, ``trade`` or null = dropped) and the
    first validation failure."""
    parsed = once(frames, parser_for(feed)(F.col("data")), "message")
    message = F.col("message")
    kind = F.try_variant_get(message, "$.e", "string")
    route = F.when(kind.isin("depthUpdate", "trade"), kind)
    reason = F.when(route == "depthUpdate", depth_reason(message)).when(
        route == "trade", trade_reason(message)
    )
    checked = once(parsed, F.struct(route.alias("route"), reason.alias("reason")), "check")
    return checked.select("*", "check.route", "check.reason").drop("check")


def rejected_frames(parsed: DataFrame) -> DataFrame:
    """Side output: routed frames that fail validation, with the reason."""
    return parsed.filter(F.col("reason").isNotNull()).drop("message")


def _levels(message: Column, path: str, side: int) -> Column:
    pairs = F.coalesce(
        F.try_variant_get(message, path, "array<array<string>>"), F.array().cast("array<array<string>>")
    )
    return F.transform(
        pairs,
        lambda pair: F.struct(
            F.lit(side).alias("side"), F.get(pair, 0).alias("price"), F.get(pair, 1).alias("qty")
        ),
    )


def flatten_frames(parsed: DataFrame) -> DataFrame:
    """One row per book level (bids, then asks, in array order) or per trade."""
    valid = parsed.filter(F.col("route").isNotNull() & F.col("reason").isNull())
    message = F.col("message")
    trade = F.struct(
        F.when(F.try_variant_get(message, "$.m", "boolean"), F.lit(1)).otherwise(F.lit(0)).alias("side"),
        F.try_variant_get(message, "$.p", "string").alias("price"),
        F.try_variant_get(message, "$.q", "string").alias("qty"),
    )
    is_trade = F.col("route") == "trade"
    items = F.when(is_trade, F.array(trade)).otherwise(
        F.concat(_levels(message, "$.b", 0), _levels(message, "$.a", 1))
    )
    rows = valid.select(
        "venue_id",
        "received_at_ns",
        "frame_no",
        "route",
        F.try_variant_get(message, "$.s", "string").alias("symbol_name"),
        ms_to_ns(
            F.when(is_trade, F.try_variant_get(message, "$.T", "bigint")).otherwise(
                F.try_variant_get(message, "$.E", "bigint")
            )
        ).alias("ts_exchange_ns"),
        F.posexplode(items).alias("pos", "item"),
    )
    return rows.select("*", "item.side", "item.price", "item.qty").drop("item")


#: Up to so many symbols (some 100 bytes each) are broadcast; more are joined by shuffle.
SMALL_DIMENSION = 100_000


def resolve_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Inner equi-join on (venue, name); unknown names drop out.

    The optimizer takes rows that were parsed from text for much smaller than they are (the parsed message has a
    share in its guess only once it is gone) and may broadcast all of them. So the join is told what to do: the
    dimension is counted and broadcast if it is small, else both sides are shuffled, and hot names are split."""
    dim = cut_lineage(symbols.select("venue_id", "symbol_name", "symbol_id"))
    dim = F.broadcast(dim) if dim.count() <= SMALL_DIMENSION else dim.hint("merge")
    return rows.join(dim, ["venue_id", "symbol_name"])


def unknown_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rejects of the symbol join, counted per (venue, name)."""
    lost = rows.join(symbols, ["venue_id", "symbol_name"], "left_anti")
    return lost.groupBy("venue_id", "symbol_name").agg(F.count(F.lit(1)).alias("n"))


def assign_sequence(rows: DataFrame, per: str = "feed") -> DataFrame:
    """+1 per emitted event in arrival then level order; ``per`` feed (venue) or symbol."""
    keys = ["venue_id"] if per == "feed" else ["venue_id", "symbol_id"]
    return row_numbers(rows, keys, ["received_at_ns", "frame_no", "pos"], "seq").drop("_chunk")


def project_events(rows: DataFrame) -> DataFrame:
    """Levels and trades as market events. A level with quantity 0 is a cancel, else a modify."""
    kind = F.when(F.col("route") == "trade", F.lit(3)).otherwise(
        F.when(F.col("qty_fp") == 0, F.lit(2)).otherwise(F.lit(1))
    )
    return rows.select(
        event_id(F.col("venue_id"), F.col("symbol_id"), F.col("seq"), F.col("ts_exchange_ns")).alias("event_id"),
        "ts_exchange_ns",
        F.col("received_at_ns").alias("ts_ingest_ns"),
        "venue_id",
        "symbol_id",
        kind.alias("event_type"),
        "side",
        "price_fp",
        "qty_fp",
        F.lit(None).cast("string").alias("order_id_hash"),
        F.lit(None).cast("string").alias("participant_id_hash"),
        F.lit(0).alias("flags"),
        "seq",
    )


def priced_rows(rows: DataFrame) -> DataFrame:
    """Text price and quantity to fixed point; rows with malformed text drop out."""
    fixed = F.struct(
        decimal_text_to_fixed(F.col("price")).alias("price_fp"),
        decimal_text_to_fixed(F.col("qty")).alias("qty_fp"),
    )
    priced = once(rows, fixed, "fixed").select("*", "fixed.price_fp", "fixed.qty_fp").drop("fixed")
    return priced.filter(F.col("price_fp").isNotNull() & F.col("qty_fp").isNotNull())


def normalize(frames: DataFrame, symbols: DataFrame, per: str = "feed", feed: str = "default") -> DataFrame:
    """Raw frames to market events. The parsed rows are written out before they are numbered, since
    numbering reads them more than once and parsing is the dear part."""
    rows = priced_rows(resolve_symbols(flatten_frames(parse_frames(frames, feed)), symbols))
    return project_events(assign_sequence(cut_lineage(rows.drop("data", "price", "qty")), per))


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds as one event table (the venue column tells them apart)."""
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed)
    return merged


# --- defaults, schema -------------------------------------------------------------------------


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast a loaded table to its canonical schema; missing columns become null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table_schema(name)
        ]
    )


def with_defaults(df: DataFrame, now_ns: int) -> DataFrame:
    """Missing flags and seq become 0, missing times become ``now_ns``."""
    return df.withColumns(
        {
            "flags": F.coalesce("flags", F.lit(0)),
            "seq": F.coalesce("seq", F.lit(0).cast("bigint")),
            "ts_exchange_ns": F.coalesce("ts_exchange_ns", F.lit(now_ns)),
            "ts_ingest_ns": F.coalesce("ts_ingest_ns", F.lit(now_ns)),
        }
    )


# --- buckets, registry, retention ----------------------------------------------------------------


def with_bucket(df: DataFrame, ts: str, width_ns: int, prefix: str) -> DataFrame:
    start = bucket_start(F.col(ts), width_ns)
    return df.withColumns(
        {
            "bucket_start_ns": start,
            "bucket_end_ns": start + F.lit(width_ns),
            "partition_name": F.concat_ws("_", F.lit(prefix), start),
        }
    )


def hourly_buckets(events: DataFrame) -> DataFrame:
    return with_bucket(events, "ts_exchange_ns", HOUR_NS, EVENT_LOG_PREFIX)


def daily_buckets(segments: DataFrame, ts: str = "start_ts_ns") -> DataFrame:
    return with_bucket(segments, ts, DAY_NS, SEGMENT_PREFIX)


def partition_registry(bucketed: DataFrame, table: str) -> DataFrame:
    """One row per bucket in use."""
    return (
        bucketed.groupBy("partition_name")
        .agg(
            F.first("bucket_start_ns").alias("range_start_ns"),
            F.first("bucket_end_ns").alias("range_end_ns"),
            F.count(F.lit(1)).alias("row_count"),
        )
        .withColumns({"table_name": F.lit(table), "tier": F.lit("hot")})
    )


# Ages of the retention tiers.
HOT_NS = 4 * HOUR_NS
WARM_NS = 30 * DAY_NS
COLD_NS = 365 * DAY_NS


def with_tier(df: DataFrame, ts: str, now_ns: int | Column) -> DataFrame:
    now = now_ns if isinstance(now_ns, Column) else F.lit(now_ns)
    age = now - F.col(ts)
    tier = (
        F.when(age < HOT_NS, "hot").when(age < WARM_NS, "warm").when(age < COLD_NS, "cold").otherwise("purge")
    )
    return df.withColumn("tier", tier)


# --- insert-ignore, ordering, sequencing -----------------------------------------------------------


def first_arrivals(batch: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """One row per key, the earliest arrival: a partial aggregate, so copies of a hot key collapse
    before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    best = batch.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*arrival)).alias("row")
    )
    return best.select(*keys, *[F.col("row")[c].alias(c) for c in rest]).select(*batch.columns)


def new_events(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` to append: first arrival of each (time, id) that the log lacks."""
    keys = ["ts_exchange_ns", "event_id"]
    return first_arrivals(batch, keys, ["ts_ingest_ns", "seq"]).join(
        log.select(*keys), keys, "left_anti"
    )


def events_by(events: DataFrame, column: str, value: int, start_ns: int, end_ns: int) -> DataFrame:
    """Events of one symbol or venue with ``start <= ts < end`` in canonical order."""
    ts = F.col("ts_exchange_ns")
    found = events.filter((F.col(column) == value) & (ts >= start_ns) & (ts < end_ns))
    if "hour_bucket" in events.columns:
        found = found.filter(
            F.col("hour_bucket").between(start_ns // HOUR_NS * HOUR_NS, (end_ns - 1) // HOUR_NS * HOUR_NS)
        )
    return canonical_order(found)


def canonical_order(events: DataFrame) -> DataFrame:
    return events.orderBy("ts_exchange_ns", "seq", "event_id")


def sequencer(events: DataFrame, arrival: list[str], reset: Column | None = None) -> DataFrame:
    """Gap rows in arrival order per (venue, symbol); ``reset`` rows start a new epoch in which the
    first event has nothing to compare with."""
    slim = events
    keys = ["venue_id", "symbol_id"]
    values = {"prev_seq": lag_of(F.col("seq"))}
    if reset is not None:
        slim = running(events.withColumn("_reset", reset.cast("bigint")), keys, arrival, _epoch=sum_of(F.col("_reset")))
        keys = [*keys, "_epoch"]
    rows = unwrap(running(slim, keys, arrival, **values), "prev_seq")
    expected = F.col("prev_seq") + 1
    size = F.col("seq") - expected
    gap_class = F.when(size > 100, "large_gap").when(size > 0, "gap").otherwise("out_of_order")
    return rows.filter(F.col("seq") != expected).select(
        "venue_id",
        "symbol_id",
        expected.alias("expected_seq"),
        F.col("seq").alias("received_seq"),
        gap_class.alias("gap_class"),
    )


def release_times(events: DataFrame, arrival: list[str], tolerance_ns: int) -> DataFrame:
    """Batch form of the reorder buffer: in arrival order, an event leaves once the newest time seen
    minus the tolerance reaches its own, the rest at the end. ``late`` marks events older than one that had
    already left; ``release_no`` is the order of leaving (step, then time, then arrival)."""
    ts = F.col("ts_exchange_ns")
    never = F.lit(1 << 40)  # step of those that leave at the end
    rows = running(events, [], arrival, _newest=max_of(ts), _before=max_of(ts, "previous"), _step=count_of()).drop("_chunk")
    rows = cut_lineage(rows)
    # the first step whose newest time reaches an event's due time: steps that set a new maximum, from above
    steps = rows.filter("_before IS NULL OR _newest > _before").select((-F.col("_newest")).alias("_down"), F.lit(0).alias("_kind"), F.col("_step").alias("_set"))
    due = rows.withColumns({"_down": -(ts + tolerance_ns), "_kind": F.lit(1)})
    due = running(due.unionByName(steps, allowMissingColumns=True), [], ["_down", "_kind"], _at=min_of(F.col("_set"))).filter("_kind = 1")
    left = cut_lineage(due.withColumn("_left", F.greatest("_step", F.coalesce("_at", never))).drop("_chunk", "_set", "_at", "_kind", "_down"))
    # the newest time that had left before an arrival
    gone = left.select(F.col("_left").alias("_spot"), F.lit(1).alias("_kind"), ts.alias("_gone"))
    seen = left.withColumns({"_spot": F.col("_step"), "_kind": F.lit(0)}).unionByName(gone, allowMissingColumns=True)
    seen = running(seen, [], ["_spot", "_kind"], _latest=max_of(F.col("_gone"))).filter("_kind = 0").drop("_chunk", "_gone", "_spot", "_kind")
    marked = seen.withColumns({"cutoff_ns": F.col("_newest") - tolerance_ns, "late": F.coalesce(ts < F.col("_latest"), F.lit(False))})
    numbered = row_numbers(cut_lineage(marked), [], ["_left", "ts_exchange_ns", "_step"], "release_no")
    return numbered.select(*events.columns, "cutoff_ns", "late", "release_no")
