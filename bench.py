"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bookweave.plans.catalog import load
from bookweave.session import local_session

HEADLINE = [
    "event_count",
    "sequence_gaps",
    "quality_verdict",
    "normalized_events",
    "insert_ignore",
    "label_rows",
    "fifo_fills",
    "positions",
    "backtest_report",
    "drawdown_monitor",
    "rolling_rates",
    "risk_check",
    "policy_decisions",
    "minted_tokens",
    "receipt_links",
    "level_history",
    "graph_edges",
    "neighborhood_nodes",
    "compaction_counts",
    "nearest_embeddings",
    "message_passing",
    "attention_pool",
    "all_heads",
    "stream_positions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    catalog = load()
    spark.read.parquet(f"{folder}/events.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "events": events,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
