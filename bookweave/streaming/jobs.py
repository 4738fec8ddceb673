"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.functions.scalars import level_key, ns_to_timestamp, order_key, symbol_key, time_bucket_key
from bookweave.operators import ingest
from bookweave.schemas import NODE
from bookweave.session import checkpoint_dir, cut_lineage
from bookweave.sources.event_log import EventLog
from bookweave.streaming.processors import (
    CooldownProcessor,
    PositionProcessor,
    ReorderProcessor,
    RetentionProcessor,
    SequencerProcessor,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder next to the checkpoints (shared storage on a cluster)."""
    return f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", end: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over everything that is there (a burst replay) into a table and read it back. ``end`` may
    add rows to the sources once that is done; the stream then goes on from its checkpoint over them."""
    spark = stream.sparkSession
    out = new_folder(spark, "stream")

    def run() -> None:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
        )
        if mode == "append":
            query = query.format("parquet").option("path", f"{out}/rows").start()
        else:
            # update output is not a file format: each batch adds its changed rows under its own number, so a
            # batch that is run again replaces its own rows
            def write(batch: DataFrame, number: int) -> None:
                batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/b={number}")

            query = query.foreachBatch(write).start()
        query.awaitTermination()

    run()
    if end:
        end()
        run()
    return spark.read.schema(_written(stream, mode)).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def _written(stream: DataFrame, mode: str):
    schema = stream.schema
    return schema if mode == "append" else schema.add("batch", T.IntegerType())


def _stateful(rows: DataFrame, keys: list[str], processor, mode: str, time: str = "None") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode=mode, timeMode=time
    )


def normalized_levels(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """Stateless part of the normaliser on a stream: parse, check, flatten, resolve, fixed point. The
    sequence number is given when a batch is appended (see ``append_normalized``)."""
    return ingest.priced_rows(ingest.resolve_symbols(ingest.flatten_frames(ingest.parse_frames(frames)), symbols))


def append_normalized(log: EventLog, symbols: DataFrame, run: str = "run") -> Callable[[DataFrame, int], None]:
    """foreachBatch body: number the batch's events after the last number of each feed and append them,
    ignoring events the log has.

    Each batch writes the last number of its feeds to a small table beside the log, before its events. A batch
    that is run again numbers its events from earlier batches only, so they get the same ids as before."""
    spark, folder = log.spark, f"{log.path}-sequence/{run}"

    def last_numbers() -> DataFrame:
        return spark.read.schema("venue_id int, _last bigint, batch bigint").parquet(folder)

    try:
        last_numbers()
    except AnalysisException:  # a new run goes on after what the log has
        start = log.read().groupBy(F.col("venue_id").cast("int").alias("venue_id")).agg(F.max("seq").alias("_last"))
        start.write.parquet(f"{folder}/batch=-1")

    def write(frames: DataFrame, number: int) -> None:
        rows = cut_lineage(ingest.assign_sequence(cut_lineage(normalized_levels(frames, symbols).drop("price", "qty"))))
        last = last_numbers().filter(F.col("batch") < number).groupBy("venue_id").agg(F.max("_last").alias("_last"))
        own = rows.groupBy(F.col("venue_id").cast("int").alias("venue_id")).agg(F.max("seq").alias("n")).join(last, "venue_id", "left")
        own.select("venue_id", (F.col("n") + F.coalesce("_last", F.lit(0))).alias("_last")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        numbered = rows.join(last, "venue_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0)))
        log.append(ingest.project_events(numbered.drop("_last")))

    return write


def reorder(events: DataFrame, key: str, tolerance_ns: int, capacity: int) -> DataFrame:
    """Events (key, event_id, ts_exchange_ns, seq, arrival, flush) in release order per feed."""
    return _stateful(events, [key], ReorderProcessor(tolerance_ns, capacity), "append")


def reorder_all(events: DataFrame, keys: DataFrame, tolerance_ns: int, capacity: int) -> DataFrame:
    """All events of the stream in release order per feed: after the last event each feed of ``keys`` (key)
    gets a flush row, so that what is still held leaves too."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession, "flush")
    columns = ["key", "event_id", "ts_exchange_ns", "seq", "arrival", "flush"]
    types = {f.name: f.dataType for f in events.schema}
    given = {"key": F.col("key"), "event_id": F.lit(None), "flush": F.lit(True)}
    flush = keys.select("key").distinct().select(*[given.get(c, F.lit(0)).cast(types[c]).alias(c) for c in columns])
    flush.limit(0).write.parquet(folder)
    both = events.select(*columns).unionByName(spark.readStream.schema(flush.schema).parquet(folder))
    return drain(reorder(both, "key", tolerance_ns, capacity), end=lambda: flush.write.mode("append").parquet(folder))


def sequence_gaps(events: DataFrame) -> DataFrame:
    return _stateful(events, ["venue_id", "symbol_id"], SequencerProcessor(), "append")


def positions(fills: DataFrame) -> DataFrame:
    return _stateful(fills, ["symbol_id"], PositionProcessor(), "update")


def alert_cooldown(alerts: DataFrame, cooldown_ns: int) -> DataFrame:
    return _stateful(alerts, ["alert_type"], CooldownProcessor(cooldown_ns), "append")


def timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("at", ns_to_timestamp(F.col("ts_exchange_ns"))).withWatermark("at", delay)


def label_windows(events: DataFrame, width: str, stride: str, delay: str) -> DataFrame:
    """Sliding windows aligned to the epoch: counts, mid price and fill / cancel flags."""
    price = F.when(F.col("price_fp") > 0, F.col("price_fp").cast("double"))
    return (
        timed(events, delay)
        .groupBy(F.window("at", width, stride))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.coalesce(F.avg(price), F.lit(0.0)).alias("mid"),
            F.bool_or(F.col("event_type") == 3).alias("fill_occurred"),
            F.bool_or(F.col("event_type") == 2).alias("cancel_occurred"),
        )
        .select("window.start", "n_events", "mid", "fill_occurred", "cancel_occurred")
    )


def unique_events(events: DataFrame, delay: str) -> DataFrame:
    """(time, id) once within the watermark; the log's own anti-join catches older repeats."""
    return timed(events, delay).dropDuplicatesWithinWatermark(["ts_exchange_ns", "event_id"]).drop("at")


def append_unique(log: EventLog) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: log.append(batch)


def node_sights(events: DataFrame) -> DataFrame:
    """The nodes that each event makes or touches: (id, kind, ts_ns, seq, depth, cancel), with the depth that the
    event states for it, if it does. Orders go by their hash; a snapshot states a level's depth, a new or changed
    order its own, a cancel leaves its order empty."""
    c, of = F.col, lambda *types: F.col("event_type").isin(*types)
    quantity, none = c("qty_fp").cast("double"), F.lit(None).cast("double")

    def sight(when, kind: str, node_id, depth=none, cancel=F.lit(0)):
        return F.when(when, F.struct(node_id.alias("id"), F.lit(NODE[kind]).alias("kind"), depth.alias("depth"), cancel.cast("int").alias("cancel")))

    order = F.when(of(0, 1), quantity).when(of(2), 0.0)
    nodes = F.array(
        sight(of(0, 1, 2, 3, 4), "Event", F.concat(F.lit("ev:"), "event_id")),
        sight(of(3), "Trade", F.concat(F.lit("trd:"), "event_id")),
        sight(of(5), "TimeBucket", time_bucket_key(c("symbol_id"), c("ts_exchange_ns"))),
        sight(of(0, 1, 2, 3) & c("order_id_hash").isNotNull(), "Order", order_key(c("order_id_hash")), order, of(2)),
        sight(of(0, 4), "PriceLevel", level_key(c("symbol_id"), c("venue_id"), c("price_fp"), c("side")), F.when(of(4), quantity)),
        sight(of(0, 3, 4, 5), "Symbol", symbol_key(c("symbol_id"))),
    )
    return events.select(c("ts_exchange_ns").alias("ts_ns"), "seq", F.inline(F.filter(nodes, lambda n: n.isNotNull())))


#: Shares of all nodes whose states are kept together; fixed, as a stream goes on from its checkpoint.
NODE_SHARES = 1024


def removed_nodes(sights: DataFrame, retention_ns: int, delay: str) -> DataFrame:
    """The nodes that leave the sliding window, as event time passes (see ``RetentionProcessor``)."""
    shared = sights.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(NODE_SHARES)).cast("int"))
    timed_rows = shared.withColumn("at", ns_to_timestamp(F.col("ts_ns"))).withWatermark("at", delay)
    processor = RetentionProcessor(retention_ns, [NODE[k] for k in ("Event", "Trade", "TimeBucket")], NODE["Order"], NODE["PriceLevel"])
    return _stateful(timed_rows, ["share"], processor, "append", "EventTime")


def live_nodes(nodes: DataFrame, retention: str = "60 seconds") -> DataFrame:
    """Node rows (id, ts_exchange_ns) on first sight; a node's state expires after the retention, so a
    later sight makes it anew, as after compaction."""
    return timed(nodes, retention).dropDuplicatesWithinWatermark(["id"]).drop("at")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key, updated with every batch."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def buffered_writer(rows: DataFrame, path: str, checkpoint: str, interval: str = "1 second"):
    """Writer that flushes what has come in every ``interval``. A batch that fails is run again from its
    checkpoint before any newer one. How many rows one flush may hold is set on the source
    (``maxFilesPerTrigger``)."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


def for_each_batch(stream: DataFrame, body: Callable[[DataFrame, int], None]) -> None:
    """Drain a stream through a batch function."""
    out = new_folder(stream.sparkSession, "batches")
    query = (
        stream.writeStream.foreachBatch(body)
        .option("checkpointLocation", out)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
