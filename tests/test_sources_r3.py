"""JSON-array frame files in pieces, logs that age through tiers, sketches with estimates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bookweave.operators import ingest as I
from bookweave.operators import registry as R
from bookweave.schemas import DAY_NS, HOUR_NS
from bookweave.sources.event_log import TieredLog
from bookweave.sources.frames import read_array_frames


@pytest.mark.parametrize("size", ["1000000", "97"])
def test_array_files_are_read_in_pieces(spark, tmp_path, size):
    rng = random.Random(4)
    odd = ['plain', 'a "quoted" {brace}', "back\\slash", "}{", '\\"', "{[", "é\n", ""]
    frames = [{"e": "trade", "T": k, "s": rng.choice(odd), "n": {"deep": [{"x": rng.choice(odd)}, {}]}, "b": [["1", "2"], []]} for k in range(120)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "dense.json").write_text(json.dumps(frames[:60], separators=(",", ":"), ensure_ascii=False))
    (folder / "loose.json").write_text(json.dumps(frames[60:100], indent=3))
    (folder / "lines.json").write_text("\n".join(json.dumps(f) for f in frames[100:]))
    (folder / "empty.json").write_text("[]")
    (folder / "broken.json").write_text('[{"e":"trade","T":7}, {"e":"tra')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = read_array_frames(spark, str(folder), 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.file, r.frame_no)):
        by_file.setdefault(r.file.rsplit("/", 1)[1], []).append((r.frame_no, json.loads(r.data), r.received_at_ns))
    assert set(by_file) == {"dense.json", "loose.json", "lines.json", "broken.json"}
    for name, own in [("dense.json", frames[:60]), ("loose.json", frames[60:100]), ("lines.json", frames[100:]), ("broken.json", [{"e": "trade", "T": 7}])]:
        assert by_file[name] == [(k, f, f["T"] * 1_000_000) for k, f in enumerate(own)], name


def test_buckets_move_through_tiers(spark, tmp_path):
    def events(*times):
        df = spark.createDataFrame([(f"e{t}", t, t) for t in times], "event_id string, ts_exchange_ns long, seq long")
        return I.conform(df.withColumns({"ts_ingest_ns": F.col("seq"), "symbol_id": F.lit(1), "venue_id": F.lit(1)}), "market_events")

    log = TieredLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.age(10**18) == []
    assert log.append(events(0, 5, HOUR_NS + 1, 9 * HOUR_NS)) == 4
    count = lambda: {(r.tier, r.hour_bucket): r["count"] for r in log.read().groupBy("tier", "hour_bucket").count().collect()}
    assert log.age(4 * HOUR_NS) == [] and set(t for t, _ in count()) == {"hot"}
    assert log.age(5 * HOUR_NS) == [(0, "hot", "warm")]
    assert log.age(5 * HOUR_NS) == []
    assert log.append(events(0, 7)) == 1  # a late event, and one that another tier has
    assert count() == {("hot", 0): 1, ("warm", 0): 2, ("hot", HOUR_NS): 1, ("hot", 9 * HOUR_NS): 1}
    assert sorted(log.age(6 * HOUR_NS)) == [(0, "hot", "warm"), (HOUR_NS, "hot", "warm")]
    assert count() == {("warm", 0): 3, ("warm", HOUR_NS): 1, ("hot", 9 * HOUR_NS): 1}
    assert log.read(["warm"]).count() == 4
    assert sorted(log.age(370 * DAY_NS)) == [(0, "warm", "purge"), (HOUR_NS, "warm", "purge"), (9 * HOUR_NS, "hot", "purge")]
    assert log.read().count() == 0


def test_estimates_are_near_the_counts(spark):
    rows = spark.range(20_000).select(F.pow(F.col("id") / 20_000 * 30, 2).cast("int").alias("v")).unionByName(spark.createDataFrame([(None,)] * 5, "v int"))
    exact = {r.v: r["count"] for r in rows.groupBy("v").count().collect() if r.v is not None}
    asked = spark.createDataFrame([(v,) for v in [*exact, 5000, -1]], "v int")
    for eps in (0.001, 0.05):
        found = {r.v: r.estimate for r in R.frequency_estimates(R.frequency_table(rows, "v", eps), asked, "v", eps).collect()}
        assert len(found) == len(exact) + 2 and all(found[v] >= n for v, n in exact.items())
        near = [found[v] - exact.get(v, 0) <= eps * 20_000 for v in found]
        assert sum(near) >= 0.95 * len(near)
    assert R.frequency_table(rows.limit(0), "v").count() == 0
