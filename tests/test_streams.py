"""Streams in several micro-batches equal the batch rules."""

import pytest
from pyspark.sql import functions as F

from bookweave.operators import pnl as P
from bookweave.streaming import jobs as J


def stream(spark, folder, df, files):
    """A stream that reads ``df`` in ``files`` micro-batches of consecutive rows."""
    rows = df.collect()
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def buffered(spark, tmp_path, rows, tolerance, capacity, files=3):
    schema = "key int, event_id string, ts_exchange_ns long, seq long, arrival long, flush boolean"
    df = spark.createDataFrame([(1, f"e{i:03}", t, i, i, f) for i, (t, f) in enumerate(rows)], schema)
    out = J.drain(J.reorder(stream(spark, tmp_path, df, files), "key", tolerance, capacity))
    return [(r.ts_exchange_ns, r.late) for r in out.orderBy("release_no").collect()]


def test_reorder_holds_back_and_flushes(spark, tmp_path):
    got = buffered(spark, tmp_path, [(10, False), (30, False), (20, False), (40, False), (35, True)], 15, 100)
    assert got == [(10, False), (20, False), (30, False), (35, False), (40, False)]


def test_reorder_without_flush_keeps_the_rest(spark, tmp_path):
    assert buffered(spark, tmp_path, [(10, False), (30, False), (20, False)], 15, 100) == [(10, False)]


def test_reorder_capacity(spark, tmp_path):
    """Capacity 4: the fifth event pushes the buffer over, and the oldest leave down to three."""
    got = buffered(spark, tmp_path, [(t, False) for t in (5, 4, 3, 2, 1)], 1000, 4)
    assert got == [(1, False), (2, False)]


def test_late_event_is_marked_not_dropped(spark, tmp_path):
    got = buffered(spark, tmp_path, [(100, False), (200, False), (50, False)], 10, 100)
    assert got == [(100, False), (50, True)]


def test_sequencer_resets(spark, tmp_path):
    rows = [(1, 1, i, f"e{i}", s, r) for i, (s, r) in enumerate([(1, False), (2, False), (5, False), (200, False), (7, False), (50, True), (51, False)])]
    df = spark.createDataFrame(rows, "venue_id int, symbol_id int, ts_ingest_ns long, event_id string, seq long, reset boolean")
    out = J.drain(J.sequence_gaps(stream(spark, tmp_path, df, 4))).collect()
    assert sorted((r.expected_seq, r.received_seq, r.gap_class) for r in out) == [
        (3, 5, "gap"), (6, 200, "large_gap"), (201, 7, "out_of_order")]


def test_positions_over_batches(spark, tmp_path):
    rows = [(1, i % 3 % 2, 100 + i, 10 + i, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol_id int, side int, price_fp long, qty_fp long, ts_ns long, seq long")
    streamed = J.drain(J.positions(stream(spark, tmp_path, df, 4)), "update").orderBy(F.desc("batch")).first()
    batch = P.positions(df).first()
    assert [streamed[c] for c in P.POSITION] == [batch[c] for c in P.POSITION]


def test_buffered_writer(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(20)], "x long")
    query = J.buffered_writer(stream(spark, tmp_path / "in", df, 4), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
