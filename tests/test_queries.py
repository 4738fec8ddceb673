"""A cross-section of the registered queries against their SQL (scripts/check_oracle.py runs all)."""

import duckdb
import pytest

from bookweave.plans.catalog import load
from scripts.check_oracle import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "quality_verdict", "sequence_gaps", "normalized_events", "insert_ignore", "label_rows", "fifo_fills", "positions",
    "backtest_report", "drawdown_monitor", "risk_check", "policy_decisions", "minted_tokens", "journal_links", "level_history",
    "graph_edges", "neighborhood_nodes", "nearest_embeddings", "nearest_to_twentieths", "reconciliation", "channel_counts", "stream_positions",
    "message_passing", "stacked_message_passing", "attention_pool", "attention_weights", "graph_embedding", "family_book_state", "family_queue_state",
    "family_event_stream", "family_cross_symbol_regime", "family_strategy_context", "family_risk_context", "composed_embedding", "mlp_forward", "all_heads",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    q = load()[name]
    df = q.run(spark, FOLDER)
    cur = con.execute(q.sql)
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.collect(), df.columns) == canon(cur.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
