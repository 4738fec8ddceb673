"""Fixes of round 4."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest

from bookweave.operators import ingest
from bookweave.operators import pnl as P
from bookweave.schemas import NODE
from bookweave.streaming import jobs as J
from bookweave.streaming.processors import ReorderProcessor, RetentionProcessor, sorted_blocks
from tests.test_streams import stream


def test_latencies_beyond_64_bits(spark):
    """Three fills that each waited 200 years: their sum in nanoseconds is above 2**63."""
    wait = 200 * 365 * 86_400 * 10**9
    orders = spark.createDataFrame([(1, n, n, n, 100) for n in range(3)], "venue_id int, order_id long, ts_ns long, seq long, price_fp long")
    fills = spark.createDataFrame([(1, wait + n, 10 + n, 101, True) for n in range(3)], "venue_id int, ts_ns long, seq long, price_fp long, is_full boolean")
    cancels = spark.createDataFrame([(1,)], "venue_id int")
    r = P.execution_stats(orders, fills, cancels, ["venue_id"]).first()
    assert (r.total_orders, r.total_fills, r.total_cancels) == (3, 3, 1)
    assert r.avg_fill_latency_ms == wait / 10**6 and round(r.total_slippage_bp, 6) == 300.0


def _parsed(spark):
    frames = spark.range(0, 2000, 1, 4).selectExpr(
        "CAST(id % 3 AS INT) AS venue_id", "id AS received_at_ns", "id AS frame_no",
        """format_string('{"e":"trade","T":%d,"s":"S%d","p":"1.5","q":"2","m":false}', id, id % 4) AS data""",
    )
    return ingest.flatten_frames(ingest.parse_frames(frames))


@pytest.mark.parametrize("small", [100_000, 0])
def test_rows_are_never_broadcast(spark, monkeypatch, small):
    """The guess for 2,000 parsed rows is below the limit, and below the size of the dimension with its long names."""
    monkeypatch.setattr(ingest, "SMALL_DIMENSION", small, raising=False)
    symbols = spark.createDataFrame([(v, f"S{s}", s) for v in range(3) for s in range(3)] + [(9, "x" * 100, 9)] * 4000, "venue_id int, symbol_name string, symbol_id int")
    found = ingest.resolve_symbols(_parsed(spark), symbols)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (small > 0)
    assert found.count() == 1500 and found.filter("concat('S', symbol_id) <> symbol_name").count() == 0


class _Value:
    def __init__(self):
        self.held, self.calls = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.held, self.calls = value, self.calls + 1

    put = update

    def clear(self):
        self.held = None


class _Handle:
    """State of one key in memory."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


def _frame(rows, columns):
    return pd.DataFrame(rows, columns=columns)


def test_sorted_blocks_merge_runs():
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "a", "é", "z", *map(str, range(30))]), n) for n in range(3000)]
    frames = (_frame(rows[i : i + 70], ["at", "id", "n"]) for i in range(0, 3000, 70))
    types = {"at": pa.int64(), "id": pa.string(), "n": pa.int64()}
    blocks = list(sorted_blocks(frames, types, ["at", "id"], run_rows=250, block_rows=16))
    got = [tuple(r.values()) for b in blocks for r in b.to_pylist()]
    last = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert [last(r) for r in got] == sorted(map(last, rows)) and sorted(n for *_, n in got) == list(range(3000))
    assert max(b.num_rows for b in blocks) <= 12 * 16


def test_reorder_lets_rows_go_in_pieces():
    """A batch of 300,000 rows of one feed, out of order: no frame holds more than a part of them."""
    n, step, columns = 300_000, 10**9, ["key", "event_id", "ts_exchange_ns", "seq", "arrival", "flush"]
    order = random.Random(2).sample(range(n), n)
    frames = (_frame([(1, f"e{i:06}", i * step, i, i * step + i * 7919 % 50 * step // 10, False) for i in order[k : k + 10_000]], columns) for k in range(0, n, 10_000))
    processor, handle = ReorderProcessor(60 * step, 1_000_000), _Handle()
    processor.init(handle)
    out = list(processor.handleInputRows((1,), frames, None))
    assert max(map(len, out)) < 70_000
    gone = pd.concat(out)
    assert gone.seq.tolist() == list(range(n - 60)) and gone.release_no.tolist() == list(range(1, n - 59)) and not gone.late.any()
    assert sorted(r[1] for r in handle.states["held"].held) == list(range(n - 60, n))


def test_retention_of_many_nodes_at_once():
    """A share of 500 nodes takes one call to read and one to write its state, whatever its nodes."""
    rng, ms, event, order, symbol = random.Random(3), 1_000_000, NODE["Event"], NODE["Order"], NODE["Symbol"]
    columns = ["id", "kind", "ts_ns", "seq", "depth", "cancel"]
    sights = [(f"{'eos'[i % 3]}{i}", (event, order, symbol)[i % 3], rng.randrange(1, 100) * ms, n, rng.choice([None, 0.0, 5.0]), 0) for n, i in enumerate(rng.choices(range(500), k=2000))]
    processor, handle = RetentionProcessor(10 * ms, [event], order, NODE["PriceLevel"]), _Handle()
    processor.init(handle)
    out = [*processor.handleInputRows((7,), iter([_frame(sights, columns)]), None)]
    assert handle.states["share"].calls <= 2 and len(handle.timers) == 1
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 95)
    out += [*processor.handleExpiredTimer((7,), clock, None)]
    want, nodes = [], {}
    for name, kind, ts, _, depth, _ in sorted(sights, key=lambda r: r[2:4]):
        node = nodes.get(name)
        ends = node and (node[1] + 10 * ms if kind == event else node[2] + 10 * ms if kind == order and node[3] == 0 else None)
        if ends is not None and ends < ts:
            want.append((name, kind, node[1], node[2], ends + 1))
            node = None
        nodes[name] = (kind, node[1] if node else ts, ts, depth if depth is not None else node[3] if node else 0.0)
    for name, (kind, made, seen, depth) in nodes.items():
        ends = made + 10 * ms if kind == event else seen + 10 * ms if kind == order and depth == 0 else None
        if ends is not None and ends // ms + 1 <= 95:
            want.append((name, kind, made, seen, ends + 1))
    assert sorted(tuple(r) for f in out for r in f.itertuples(index=False)) == sorted(want) and want


def test_retention_is_kept_by_shares(spark, tmp_path):
    """Two micro-batches over 3,000 nodes: a state call for each node took minutes, shares take seconds."""
    rows = [(f"n{i}", NODE["Event"], (1000 + i // 300) * 1_000_000, i, None, 0) for i in range(3000)]
    sights = stream(spark, tmp_path, spark.createDataFrame(rows, "id string, kind int, ts_ns long, seq long, depth double, cancel int"), 2)
    removed = J.removed_nodes(sights, 3_000_000, "0 seconds")
    assert "share" in removed._jdf.queryExecution().logical().toString()
    got = J.drain(removed).collect()
    assert {r.id for r in got} == {f"n{i}" for i in range(1800)} and len(got) == 1800
