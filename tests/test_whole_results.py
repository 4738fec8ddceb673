"""Queries that return the whole result, against their SQL, and the flush after the last event."""

import duckdb
import pytest
from pyspark.sql import functions as F

from bookweave.plans.catalog import load
from bookweave.streaming import jobs as J
from scripts.check_oracle import TABLES, canon
from tests.test_streams import stream

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_released", "stream_reordered", "dense_node_values", "packed_values"])
def test_query_equals_sql(spark, name):
    con, q = duckdb.connect(), load()[name]
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, cur = q.run(spark, FOLDER), con.execute(q.sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), columns)


def test_flush_after_the_last_event(spark, tmp_path):
    """In several micro-batches; a late event, and times that a double can't hold."""
    base = 1_700_000_000_000_000_001
    times = [(1, 100), (1, 200), (1, 50), (2, 7), (2, 3), (1, 195)]
    schema = "key int, event_id string, ts_exchange_ns long, seq long, arrival long, flush boolean"
    df = spark.createDataFrame([(k, f"e{i}", base + t, i, i, False) for i, (k, t) in enumerate(times)], schema)
    got = J.reorder_all(stream(spark, tmp_path, df, 3), df, 10, 100).orderBy("key", F.col("release_no")).collect()
    assert [(r.key, r.ts_exchange_ns - base, r.late) for r in got] == [(1, 100, False), (1, 50, True), (1, 195, False), (1, 200, False), (2, 3, False), (2, 7, False)]
