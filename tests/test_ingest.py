import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from bookweave.functions.scalars import decimal_text_to_fixed, event_id, floor_div
from bookweave.operators import ingest as I
from bookweave.schemas import HOUR_NS
from bookweave.sources.event_log import EventLog
from bookweave.sources.frames import read_frames, register_parser


@pytest.mark.parametrize(
    "text, value",
    [("1", 100000000), ("0.00123400", 123400), ("1.123456789", 112345678), ("-0.5", -50000000), ("5.", 500000000),
     ("abc", None), ("", None), ("1.2.3", None), (".5", None), ("1e5", None), ("--1", None)],
)
def test_fixed_point(spark, text, value):
    row = spark.createDataFrame([(text,)], "t string").select(decimal_text_to_fixed(F.col("t")).alias("v")).first()
    assert row.v == value


def test_event_id_is_the_hash_of_the_packed_bytes(spark):
    df = spark.createDataFrame([(2, 7, 9, 1_700_000_000_000_000_000), (1, -3, 5, 12)], "v int, s int, q long, t long")
    for r in df.select("*", event_id(F.col("v"), F.col("s"), F.col("q"), F.col("t")).alias("id")).collect():
        packed = struct.pack(">iiqq4x", r.v, r.s, r.q, r.t)
        assert r.id == hashlib.sha256(packed).hexdigest()[:32]


def test_floor_div_rounds_down(spark):
    df = spark.createDataFrame([(-7,), (7,), (-8,)], "x long").select(floor_div(F.col("x"), 4).alias("y"))
    assert [r.y for r in df.collect()] == [-2, 1, -2]


FRAMES = [
    {"e": "depthUpdate", "E": 1000, "s": "AAA", "U": 1, "u": 2, "b": [["10.5", "1"], ["10.4", "0"]], "a": [["10.6", "2"], ["x", "1"]]},
    {"e": "trade", "E": 1050, "s": "AAA", "t": 1, "p": "10.5", "q": "0.25", "b": 7, "a": 8, "T": 1051, "m": True, "M": True},
    {"e": "trade", "E": 1100, "s": "BBB", "t": 2, "p": "1", "q": "1", "T": 1101, "m": False},
    {"e": "trade", "E": 1100, "s": "AAA", "t": 2, "p": 1, "q": "1", "T": 1101, "m": False},
    {"e": "depthUpdate", "E": "1100", "s": "AAA", "b": [], "a": []},
    {"result": None, "id": 1},
    {"e": "kline"},
]


def test_frame_file_to_events(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps(FRAMES))
    frames = read_frames(spark, str(tmp_path), 3)
    assert frames.count() == 7
    symbols = spark.createDataFrame([(3, "AAA", 11)], "venue_id int, symbol_name string, symbol_id int")
    parsed = I.parse_frames(frames)
    assert sorted(r.reason for r in I.rejected_frames(parsed).collect()) == ["missing event time", "missing price"]
    events = sorted(I.normalize(frames, symbols).collect(), key=lambda r: r.seq)
    assert [(e.event_type, e.side, e.price_fp, e.qty_fp, e.ts_exchange_ns) for e in events] == [
        (1, 0, 1_050_000_000, 100_000_000, 1_000_000_000),
        (2, 0, 1_040_000_000, 0, 1_000_000_000),
        (1, 1, 1_060_000_000, 200_000_000, 1_000_000_000),
        (3, 1, 1_050_000_000, 25_000_000, 1_051_000_000),
    ]
    assert [e.seq for e in events] == [1, 2, 3, 4]


def test_custom_parser(spark):
    register_parser("pipes", lambda text: F.try_parse_json(F.format_string(
        '{"e":"trade","T":%s,"s":"%s","p":"%s","q":"1","m":false}',
        F.split_part(text, F.lit("|"), F.lit(1)), F.split_part(text, F.lit("|"), F.lit(2)), F.split_part(text, F.lit("|"), F.lit(3)))))
    frames = spark.createDataFrame([(1, 5, 0, "77|AAA|2.5")], "venue_id int, received_at_ns long, frame_no long, data string")
    symbols = spark.createDataFrame([(1, "AAA", 4)], "venue_id int, symbol_name string, symbol_id int")
    row = I.normalize(frames, symbols, feed="pipes").first()
    assert (row.symbol_id, row.price_fp, row.ts_exchange_ns) == (4, 250_000_000, 77_000_000)


def events(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, ts_exchange_ns long, seq long")
    return I.conform(df.withColumns({"ts_ingest_ns": F.col("seq"), "symbol_id": F.lit(1), "venue_id": F.lit(1)}), "market_events")


def test_event_log_append_is_idempotent(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    batch = events(spark, [("a", 1, 1), ("b", HOUR_NS + 5, 2), ("b", HOUR_NS + 5, 9)])
    assert log.append(batch) == 2
    assert log.append(batch) == 0
    assert log.append(events(spark, [("b", HOUR_NS + 5, 3), ("c", 3 * HOUR_NS, 4)])) == 1
    assert sorted((r.event_id, r.seq) for r in log.read().collect()) == [("a", 1), ("b", 2), ("c", 4)]
    assert [r.event_id for r in log.read(HOUR_NS, 3 * HOUR_NS).collect()] == ["b"]
    plan = log.read(HOUR_NS, 2 * HOUR_NS)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "hour_bucket" in plan


def test_tiers(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    log.append(events(spark, [("new", 400 * 24 * HOUR_NS, 1), ("warm", 395 * 24 * HOUR_NS, 2), ("cold", 300 * 24 * HOUR_NS, 3), ("old", 5, 4)]))
    folders = log.tiered(400 * 24 * HOUR_NS + 1, str(tmp_path / "tiers"))
    got = {t: [r.event_id for r in spark.read.parquet(p).collect()] for t, p in folders.items()}
    assert got == {"hot": ["new"], "warm": ["warm"], "cold": ["cold"]}
