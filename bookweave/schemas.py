"""Explicit schemas of the logical tables and the fixed codes used in them."""

from __future__ import annotations

from pyspark.sql import types as T

# Enum codes in natural order.
EVENT_TYPES = ["NewOrder", "ModifyOrder", "CancelOrder", "Trade", "BookSnapshot", "SessionMarker", "VenueStatus"]
SIDES = ["Bid", "Ask"]
NODE_KINDS = ["Symbol", "Venue", "PriceLevel", "Order", "Trade", "Event", "Participant", "TimeBucket", "Regime", "StrategyState"]
EDGE_KINDS = ["AtLevel", "NextTick", "Generated", "Matched", "ModifiedFrom", "CanceledBy", "BelongsToSymbol", "OnVenue", "InWindow", "CorrelatedWith", "InRegime", "AffectsState"]
PROPERTY_KEYS = ["VisibleDepth", "EstimatedHiddenDepth", "QueueLength", "LocalImbalance", "RefillRate", "DepletionRate", "SpreadDistance", "LocalRealizedVol", "CancelHazard", "FillHazard", "SlippageToMid", "PostTradeImpact", "InfluenceScore", "CoherenceContribution", "QueueEstimate", "Age", "ModifyCount"]
REGIMES = ["Calm", "Normal", "Volatile"]

EVENT = {name: code for code, name in enumerate(EVENT_TYPES)}
NODE = {name: code for code, name in enumerate(NODE_KINDS)}
EDGE = {name: code for code, name in enumerate(EDGE_KINDS)}
PROP = {name: code for code, name in enumerate(PROPERTY_KEYS)}

# Scales and durations.
INGEST_SCALE = 100_000_000
RISK_SCALE = 1_000_000
SECOND_NS = 1_000_000_000
HOUR_NS = 3_600_000_000_000
DAY_NS = 86_400_000_000_000
EVENT_LOG_PREFIX = "nt_event_log"
SEGMENT_PREFIX = "nt_segments"


def _schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


MARKET_EVENT_DDL = (
    "event_id STRING, ts_exchange_ns BIGINT, ts_ingest_ns BIGINT, venue_id INT, symbol_id INT, "
    "event_type INT, side INT, price_fp BIGINT, qty_fp BIGINT, order_id_hash STRING, "
    "participant_id_hash STRING, flags INT, seq BIGINT"
)
RAW_FRAME_DDL = "venue_id INT, received_at_ns BIGINT, data STRING"
FILL_DDL = "symbol_id INT, side INT, price_fp BIGINT, qty_fp BIGINT, ts_ns BIGINT, seq BIGINT"
SEGMENT_DDL = (
    "segment_id BIGINT, symbol_id INT, start_ts_ns BIGINT, end_ts_ns BIGINT, segment_kind STRING, "
    "data_blob BINARY, signature BINARY, witness_hash BINARY, metadata STRING"
)
RECEIPT_DDL = (
    "receipt_id BIGINT, ts_ns BIGINT, model_id STRING, input_hash STRING, coherence_hash STRING, "
    "policy_hash STRING, action_type STRING, token_id STRING, result_hash STRING"
)
MODEL_DDL = (
    "model_id BIGINT, name STRING, version INT, promoted_at TIMESTAMP, retired_at TIMESTAMP"
)
EMBEDDING_DDL = (
    "embedding_id BIGINT, symbol_id INT, venue_id INT, ts_ns BIGINT, embedding_type STRING, "
    "dimension INT, metadata STRING, vector ARRAY<FLOAT>"
)
NODE_DDL = (
    "id STRING, kind INT, properties MAP<INT,DOUBLE>, created_at_ns BIGINT, updated_at_ns BIGINT"
)
EDGE_DDL = (
    "id STRING, kind INT, source_id STRING, target_id STRING, properties MAP<STRING,DOUBLE>, "
    "created_at_ns BIGINT"
)

TABLES = {
    "market_events": MARKET_EVENT_DDL,
    "raw_frames": RAW_FRAME_DDL,
    "fills": FILL_DDL,
    "segments": SEGMENT_DDL,
    "policy_receipts": RECEIPT_DDL,
    "model_registry": MODEL_DDL,
    "embeddings": EMBEDDING_DDL,
    "graph_nodes": NODE_DDL,
    "graph_edges": EDGE_DDL,
}


def table_schema(name: str) -> T.StructType:
    """Parsed schema of one logical table (needs a running session)."""
    return _schema(TABLES[name])
