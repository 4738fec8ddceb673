"""Order of leaving, replayed batches, equal times and wide cuts."""

from pyspark.sql import functions as F

from bookweave.operators import audit, ingest, ordered, registry
from bookweave.session import cut_lineage
from bookweave.sources import driver_tables
from bookweave.sources.event_log import EventLog
from bookweave.streaming import jobs


def released(spark, times, tolerance):
    rows = [(f"e{i}", t, i) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id string, ts_exchange_ns long, arrival long")
    return {r.event_id: r for r in ingest.release_times(events, ["arrival", "event_id"], tolerance).collect()}


def by_rule(times, tolerance):
    held, newest, last, out = [], None, None, []
    for i, t in enumerate(times):
        held.append((t, i))
        newest = t if newest is None else max(newest, t)
        ready = sorted(x for x in held if x[0] <= newest - tolerance)
        held = [x for x in held if x not in ready]
        for ts, j in ready:
            out.append((f"e{j}", last is not None and ts < last))
            last = ts if last is None else max(last, ts)
    for ts, j in sorted(held):
        out.append((f"e{j}", last is not None and ts < last))
        last = ts if last is None else max(last, ts)
    return out


def test_late_is_older_than_what_has_left(spark):
    got = released(spark, [100, 200, 150], 10)
    assert not any(r.late for r in got.values())


def test_release_order_follows_the_rule(spark):
    times = [(i * 37 + (i * i * 13) % 90) % 400 + i for i in range(120)]
    got = released(spark, times, 25)
    want = by_rule(times, 25)
    assert any(late for _, late in want)
    assert [(e, got[e].late) for e in sorted(got, key=lambda e: got[e].release_no)] == want


def test_receipts_of_one_instant_stay_single(spark):
    rows = [("a", 1, "place", "p", 0.5, 7), ("b", 1, "cancel", "p", 0.5, 8)]
    acted = spark.createDataFrame(rows, "event_id string, ts_ns long, action_type string, partition_hash string, drift_score double, seq long")
    got = audit.receipts(acted, "m", "seq").collect()
    assert sorted(r.seq for r in got) == [7, 8]


def test_many_hot_times_at_cluster_width(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4000")
        rows = spark.range(60_000).select((F.col("id") % 1200).alias("t"), "id")
        cut = ordered.with_chunks(rows, [], "t", "id")
        pieces = cut.groupBy("_chunk").agg(F.count("*").alias("n"), F.countDistinct("t").alias("times"))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert max(r.times for r in pieces.collect()) <= 2
        monotone = cut.groupBy("t").agg(F.min("_chunk").alias("lo"), F.max("_chunk").alias("hi")).orderBy("t").collect()
        assert all(a.hi <= b.lo for a, b in zip(monotone, monotone[1:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_latency_of_all_samples(spark):
    rows = [("s", float(v % 50), v, v) for v in range(12_000)]
    samples = spark.createDataFrame(rows, "stage string, value double, ts_ns long, seq long")
    got = registry.latency_summary(samples).first()
    values = sorted(r[1] for r in rows)
    assert (got["count"], got.p50, got.p99) == (12_000, values[6_000], values[11_880])


def test_replayed_batch_adds_nothing(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    events = driver_tables.market_events(spark, folder).orderBy("ts_exchange_ns").limit(60)
    frames = cut_lineage(driver_tables.shape_frames(events))
    log = EventLog(spark, str(tmp_path / "log"))
    symbols = driver_tables.symbol_dimension(spark, folder)
    write = jobs.append_normalized(log, symbols)
    write(frames, 0)
    first = {r.event_id for r in log.read().collect()}
    write(frames, 0)
    jobs.append_normalized(log, symbols)(frames, 0)  # after a restart
    again = [r.event_id for r in log.read().collect()]
    assert first and sorted(first) == sorted(again)
    write(frames, 1)
    assert log.read().count() == 2 * len(first)
