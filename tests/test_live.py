"""Live streams in several micro-batches, one of them run twice, equal the batch operators over all events."""

import pytest
from pyspark.sql import functions as F

from bookweave.operators import labels as L
from bookweave.plans.stream_plans import LIVE_HEADS, live_layers, register_live_heads
from bookweave.sources.driver_tables import market_events
from bookweave.streaming import live as LV

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    rows = market_events(spark, FOLDER).orderBy("ts_exchange_ns", "seq").limit(90)
    return spark.createDataFrame(rows.collect(), rows.schema).withColumn("ts_ns", F.col("ts_exchange_ns"))


def batches(events, n):
    rows = events.orderBy("ts_exchange_ns", "seq").collect()
    size = -(-len(rows) // n)
    return [events.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], events.schema) for i in range(n)]


def listed(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(sorted(df.columns)).collect())


def test_decisions_of_batches_are_those_of_all_events(spark, events, tmp_path):
    register_live_heads()
    layers = live_layers(spark)
    stream = LV.DecisionStream(spark, str(tmp_path), layers, LIVE_HEADS)
    for number, batch in enumerate(batches(events, 3)):
        stream.write(batch, number)
        if number == 1:
            stream.write(batch, number)  # as after a failure
    stream.write(events.limit(0), 3)
    whole = LV.decision_tables(LV.score_events(events, layers, names=LIVE_HEADS), "gnn-v1")
    assert set(whole) == set(LV.TABLES)
    for name, rows in whole.items():
        assert listed(stream.read(name)) == listed(rows), name
    actions = {r.action_type for r in stream.read("decisions").select("action_type").distinct().collect()}
    assert "hold" in actions and len(actions) > 1 and stream.read("segments").count() == stream.read("receipts").count() > 0


@pytest.mark.parametrize("parts", [1, 4])
def test_labels_of_batches_are_those_of_all_events(spark, events, tmp_path, parts):
    hour = 3_600_000_000_000
    stream = LV.LabelStream(spark, str(tmp_path), 2 * hour, hour // 2, hour // 2)
    for number, batch in enumerate(batches(events, parts)):
        stream.write(batch, number)
        if number == 2:
            before = listed(stream.read())
            stream.write(batch, number)
            assert listed(stream.read()) == before
    early = stream.read().count()
    newest = events.agg(F.max("ts_exchange_ns")).first()[0]
    grid = L.Windows(0, newest // (hour // 2), 2 * hour, hour // 2)
    want = L.label_rows(events, 2 * hour, hour // 2, grid)
    assert early > 0 and listed(stream.finish()) == listed(want) and stream.read().count() > early


def test_late_events_change_no_label(spark, events, tmp_path):
    hour = 3_600_000_000_000
    stream = LV.LabelStream(spark, str(tmp_path), 2 * hour, hour, 0)
    first, second = batches(events, 2)
    stream.write(second, 0)
    before = listed(stream.read())
    stream.write(first, 1)
    assert listed(stream.read()) == before and stream.log.read().count() == 90


def test_empty_stream(spark, events, tmp_path):
    labels = LV.LabelStream(spark, str(tmp_path / "labels"), 10, 5, 0)
    assert labels.finish().count() == 0
    labels.write(events.limit(0), 0)
    assert labels.finish().count() == 0
