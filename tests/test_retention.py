"""Streaming retention in several micro-batches against a loop over the sights."""

import pytest
from pyspark.sql import functions as F

from bookweave.schemas import NODE
from bookweave.streaming import jobs as J
from tests.test_streams import stream

MS = 1_000_000


@pytest.mark.parametrize("files", [1, 5])
def test_nodes_leave_by_kind(spark, tmp_path, files):
    event, order, level, symbol, regime = (NODE[k] for k in ("Event", "Order", "PriceLevel", "Symbol", "Regime"))
    rows = [  # id, kind, ms, depth, cancel
        ("e1", event, 0, None, 0), ("s", symbol, 0, None, 0), ("r", regime, 1, None, 0), ("o1", order, 2, 5.0, 0), ("o2", order, 3, 5.0, 0),
        ("o2", order, 4, 0.0, 1), ("o4", order, 4, None, 0), ("l1", level, 5, 7.0, 0), ("l2", level, 6, None, 0), ("o1", order, 20, 0.0, 0),
        ("l2", level, 30, 4.0, 0), ("o2", order, 31, 5.0, 0), ("l1", level, 40, 0.0, 0), ("e2", event, 95, None, 0), ("s", symbol, 100, None, 0),
    ]
    kind = "id string, kind int, ts_ns long, seq long, depth double, cancel int"
    df = spark.createDataFrame([(i, k, (t + 1000) * MS, n, d, c) for n, (i, k, t, d, c) in enumerate(rows)], kind)
    got = J.drain(J.removed_nodes(stream(spark, tmp_path, df, files), 10 * MS, "0 seconds")).collect()
    # e2 is within the retention; o1 and l1 leave once empty, o2 and l2 begin anew and then hold something
    want = {("e1", event, 0, 0, 10), ("o2", order, 3, 4, 14), ("o4", order, 4, 4, 14), ("l2", level, 6, 6, 16), ("o1", order, 2, 20, 30), ("l1", level, 5, 40, 50)}
    assert {(r.id, r.kind, r.created_at_ns // MS - 1000, r.updated_at_ns // MS - 1000, (r.removed_at_ns - 1) // MS - 1000) for r in got} == want
    assert len(got) == len(want)


def test_sights_of_events(spark):
    kind = "event_id string, ts_exchange_ns long, seq long, venue_id int, symbol_id int, event_type int, side int, price_fp long, qty_fp long, order_id_hash string"
    events = spark.createDataFrame([("a", 1, 1, 1, 2, 0, 0, 10, 5, "h"), ("b", 2, 2, 1, 2, 3, 0, 10, 2, "h"), ("c", 3, 3, 1, 2, 4, 0, 10, 9, None), ("d", 4, 4, 1, 2, 5, 0, 0, 0, None)], kind)
    got = J.node_sights(events).groupBy("seq").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.seq: r.n for r in got} == {1: 4, 2: 4, 3: 3, 4: 2}
