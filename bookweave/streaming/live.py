"""The live decision pipeline and live window labels: micro-batches through the batch operators.

A batch writes each of its tables under its own number, and the state that the next batch needs as well. It reads
state of earlier batches only, so a batch that is run again after a failure writes the same rows over its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.operators import audit as A
from bookweave.operators import gate as G
from bookweave.operators import labels as L
from bookweave.operators import model as M
from bookweave.operators.ordered import Running, count_of, running, sum_of
from bookweave.operators.topk import latest_per_key
from bookweave.sources.event_log import EventLog
from bookweave.streaming.jobs import for_each_batch


class Numbered:
    """A table of which every batch writes its own part, ``folder/batch=N``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/batch=-1")

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def read(self, below: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self.folder)
        return (rows if below is None else rows.filter(F.col("batch") < below)).drop(*([] if below is not None else ["batch"]))


# --- features and decisions -------------------------------------------------------------------------------------

#: Running sums per symbol that the features are made of: events, events by type, prices in cents, signed and
#: unsigned quantity.
SUMS = ["n", *[f"n{k}" for k in range(5)], "cents", "flow", "volume"]
STATE = "symbol_id int, " + ", ".join(f"{n} bigint" for n in SUMS)


def _sums() -> dict[str, Running]:
    signed = F.when(F.col("side") == 0, F.col("qty_fp")).otherwise(-F.col("qty_fp"))
    types = [count_of(F.col("event_type") == k) for k in range(5)]
    return dict(zip(SUMS, [count_of(), *types, sum_of(F.floor(F.col("price_fp") / 1_000_000)), sum_of(signed), sum_of(F.col("qty_fp"))]))


def symbol_sums(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Events with the sums of their symbol up to and including them; ``before`` has those of earlier batches."""
    rows = running(events, ["symbol_id"], ["ts_ns", "seq"], **_sums()).drop("_chunk")
    if before is None:
        return rows
    earlier = before.select(F.col("symbol_id").alias("_symbol"), *[F.col(n).alias(f"_{n}") for n in SUMS])
    joined = rows.join(earlier, F.col("symbol_id") == F.col("_symbol"), "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in SUMS}).drop("_symbol", *[f"_{n}" for n in SUMS])


def symbol_features(sums: DataFrame) -> DataFrame:
    """Adds x, eight features of the symbol at the event: shares of the event types, distance of the price from its
    mean so far, order flow over volume, and the side."""
    mean = F.col("cents") / F.col("n")
    price = (F.floor(F.col("price_fp") / 1_000_000) - mean) / F.greatest(mean, F.lit(1.0))
    flow = F.col("flow") / F.greatest(F.col("volume"), F.lit(1))
    return sums.withColumn("x", F.array(*[F.col(f"n{k}") / F.col("n") for k in range(5)], price, flow, F.col("side").cast("double")))


KEYS = ["seq", "event_id", "ts_ns", "symbol_id", "venue_id", "flow"]
TABLES = {
    "predictions": "seq bigint, ts_ns bigint, symbol_id int, head_name string, value double, confidence double",
    "decisions": "seq bigint, ts_ns bigint, symbol_id int, net_qty_fp bigint, action_type string, rule string, allow_act boolean, allow_write boolean",
    "receipts": "receipt_id bigint, ts_ns bigint, model_id string, input_hash string, coherence_hash string, policy_hash string, action_type string, token_id string, result_hash string",
    "segments": "symbol_id int, start_ts_ns bigint, end_ts_ns bigint, segment_kind string, metadata string",
}


def score_events(events: DataFrame, layers: dict, before: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Long head rows (seq, event_id, ts_ns, symbol_id, venue_id, flow, head_name, value, confidence) of events."""
    return M.score_heads(symbol_features(symbol_sums(events, before)).select(*KEYS, "x"), "x", layers, names)


def decision_tables(scores: DataFrame, model_id: str) -> dict[str, DataFrame]:
    """Head rows -> predictions, decisions, receipts and action segments.

    Predictions are those of the prediction heads. Gate inputs and policy signals come from the other heads, the
    gate's regime from the regime head (1 without it). What the policy places, modifies or cancels gets a receipt,
    and an action segment if the gate lets it write. The venue counts as open and the budgets as unused."""
    regime = F.coalesce(F.max(F.when(F.col("head_name") == "regime_transition", F.col("value"))), F.lit(1.0)).cast("int")
    context = scores.groupBy(*KEYS).agg(*G.signal_columns(), *G.metric_columns(), regime.alias("regime"))
    fixed = {"kill_active": False, "venue_halted": False, "venue_healthy": True, "slippage_bp": 0.0, "order_rate_ratio": 0.0, "cancel_rate_ratio": 0.0}
    decided = G.decide(G.coherence_gate(context).withColumns({"partition_hash": F.lit("fallback-no-hash"), **{k: F.lit(v) for k, v in fixed.items()}}))
    decided = decided.withColumns({"action_type": F.col("action.type"), "rule": F.col("action.rule"), "net_qty_fp": F.col("flow"), "receipt_id": F.col("seq")})
    acted = decided.filter(F.col("action_type").isin("place", "modify", "cancel")).withColumn("order_id", F.concat(F.lit("o"), "seq"))
    tables = {
        "predictions": scores.filter(F.col("head_name").isin(*M.PREDICTION_HEADS)),
        "decisions": decided,
        "receipts": A.receipts(acted, model_id, "receipt_id"),
        "segments": A.action_segments(acted),
    }
    return {name: rows.select(*[c.split()[0] for c in TABLES[name].split(", ")]) for name, rows in tables.items()}


class DecisionStream:
    """Events in, predictions, decisions, receipts and action segments out, under one folder."""

    def __init__(self, spark: SparkSession, folder: str, layers: dict, names: list[str] | None = None, model_id: str = "gnn-v1"):
        self.layers, self.names, self.model_id = layers, names, model_id
        self.tables = {name: Numbered(spark, f"{folder}/{name}", schema) for name, schema in TABLES.items()}
        self.state = Numbered(spark, f"{folder}/state", STATE)
        self.scores = Numbered(spark, f"{folder}/scores", "seq bigint, event_id string, ts_ns bigint, symbol_id int, venue_id int, flow bigint, head_name string, value double, confidence double")

    def write(self, events: DataFrame, number: int) -> None:
        """foreachBatch body. Events of a batch are taken in time order, batches in the order they come."""
        before = latest_per_key(self.state.read(below=number), ["symbol_id"], ["batch"]).drop("batch")
        sums = symbol_sums(events, before)
        last = sums.groupBy("symbol_id").agg(F.max_by(F.struct(*SUMS), F.struct("ts_ns", "seq")).alias("s")).select("symbol_id", "s.*")
        self.state.write(last, number)
        scored = M.score_heads(symbol_features(sums).select(*KEYS, "x"), "x", self.layers, self.names)
        self.scores.write(scored, number)
        own = self.scores.read(below=number + 1).filter(F.col("batch") == number).drop("batch")
        for name, rows in decision_tables(own, self.model_id).items():
            self.tables[name].write(rows, number)

    def run(self, stream: DataFrame) -> DecisionStream:
        for_each_batch(stream, self.write)
        return self

    def read(self, table: str) -> DataFrame:
        return self.tables[table].read()


# --- labels --------------------------------------------------------------------------------------------------------

LABELS = "window_index bigint, mid_price_move_bp double, fill_occurred boolean, cancel_occurred boolean, slippage_bp double, vol_jump boolean, regime_label int"


class LabelStream:
    """All six labels of sliding windows on a stream. Window k is ``[k * stride, + width)`` from the epoch.

    A batch appends its events to the log. The windows that close with it, those whose next window ended
    ``delay`` before the newest event, are labelled by the batch operator over just their part of the log. A window
    is labelled once; events that come later than the delay are in the log but change no label. ``finish``
    labels the windows that are still open, as far as they hold events."""

    def __init__(self, spark: SparkSession, folder: str, width: int, stride: int, delay: int):
        self.log, self.width, self.stride, self.delay = EventLog(spark, f"{folder}/log"), width, stride, delay
        self.labels = Numbered(spark, f"{folder}/labels", LABELS)
        self.marks = Numbered(spark, f"{folder}/marks", "newest bigint")

    def _closed(self, newest: int | None) -> int:
        """The last window that has closed when ``newest`` is the newest event time; -1 for none."""
        return -1 if newest is None else max(-1, (newest - self.delay - 2 * self.width) // self.stride)

    def _labels(self, first: int, last: int) -> DataFrame:
        grid = L.Windows(0, last, self.width, self.stride)
        part = self.log.read(first * self.stride, last * self.stride + 2 * self.width)
        return L.label_rows(part, self.width, self.stride, grid).filter(F.col("window_index") >= first)

    def write(self, events: DataFrame, number: int) -> None:
        """foreachBatch body."""
        self.log.append(events)
        earlier = self.marks.read(below=number).agg(F.max("newest")).first()[0]
        own = events.agg(F.max("ts_exchange_ns")).first()[0]
        newest = max((t for t in (earlier, own) if t is not None), default=None)
        first, last = self._closed(earlier) + 1, self._closed(newest)
        if first == 0:  # windows before the first event hold nothing
            oldest = self.log.read().agg(F.min("ts_exchange_ns")).first()[0]
            first = max(0, (oldest - self.width) // self.stride + 1) if oldest is not None else 0
        if first <= last:
            self.labels.write(self._labels(first, last), number)
        self.marks.write(events.sparkSession.createDataFrame([(newest,)], "newest bigint"), number)

    def run(self, stream: DataFrame) -> LabelStream:
        for_each_batch(stream, self.write)
        return self

    def finish(self) -> DataFrame:
        """All labels, those of the open windows included."""
        newest, number = self.marks.read(below=1 << 62).agg(F.max("newest"), F.max("batch")).first()
        if newest is not None:
            oldest = self.log.read().agg(F.min("ts_exchange_ns")).first()[0]
            first = max(self._closed(newest) + 1, (oldest - self.width) // self.stride + 1, 0)
            self.labels.write(self._labels(first, newest // self.stride), number + 1)
        return self.read()

    def read(self) -> DataFrame:
        return self.labels.read()


def start(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second"):
    """A running query over ``body`` (the ``write`` of a stream above) that goes on from its checkpoint."""
    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
