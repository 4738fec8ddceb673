"""Streaming queries: the event table drained through streams, equal to the batch results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bookweave.functions.scalars import int_div
from bookweave.operators import ingest
from bookweave.operators import model as M
from bookweave.operators.gate import decide
from bookweave.operators.ingest import EVENT_COLUMNS
from bookweave.operators.topk import latest_per_key
from bookweave.plans import model_sql as MS
from bookweave.plans.catalog import query
from bookweave.plans.gate_plans import PO
from bookweave.plans.ingest_plans import EVENT_COLS, FR, ME, SEQUENCER
from bookweave.plans.label_plans import WIN, R, S, W, rounded
from bookweave.plans.model_plans import mlp_layers
from bookweave.plans.pnl_plans import COOL, FI, POS
from bookweave.sources import driver_tables as D
from bookweave.sources.event_log import EventLog
from bookweave.sources.frames import read_array_frames, read_frames, register_parser
from bookweave.streaming import jobs as J
from bookweave.streaming import live as LV


@query("replayed_events", "K11 K1", ME + f"SELECT {EVENT_COLS} FROM me")
def _(spark, d):
    return J.drain(D.event_stream(spark, d))


@query("stream_levels", "K1", FR + "SELECT venue_id, symbol_id, frame_no, pos, side, price_fp, qty_fp, ts_exchange_ns FROM ne")
def _(spark, d):
    frames = D.shape_frames(D.event_stream(spark, d))
    rows = J.normalized_levels(frames, D.symbol_dimension(spark, d))
    return J.drain(rows.select("venue_id", "symbol_id", "frame_no", "pos", "side", "price_fp", "qty_fp", "ts_exchange_ns"))


@query("stream_normalized_log", "K1 K6", FR + f"SELECT {EVENT_COLS} FROM norm")
def _(spark, d):
    log = EventLog(spark, J.new_folder(spark, "log"))
    J.for_each_batch(D.shape_frames(D.event_stream(spark, d)), J.append_normalized(log, D.symbol_dimension(spark, d)))
    return log.read().select(*EVENT_COLUMNS)


@query(
    "stream_reordered",
    "K2 K4",
    ME + "SELECT event_id FROM (SELECT *, max(ts_exchange_ns) OVER (PARTITION BY venue_id) AS newest FROM me) WHERE ts_exchange_ns <= newest - 3600000000000",
)
def _(spark, d):
    """Arrivals are delayed by up to ten seconds per quantity; all but the last hour has left."""
    events = D.event_stream(spark, d).select(
        F.col("venue_id").alias("key"), "event_id", "ts_exchange_ns", "seq",
        (F.col("ts_exchange_ns") + F.col("qty_fp") * 100).alias("arrival"), F.lit(False).alias("flush"),
    )
    return J.drain(J.reorder(events, "key", 3_600_000_000_000, 1_000_000)).select("event_id")


@query(
    "stream_released",
    "K2 K4",
    ME + "SELECT venue_id AS key, event_id, row_number() OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq, event_id) AS release_no, false AS late FROM me",
)
def _(spark, d):
    """As stream_reordered, but all events leave: each venue is flushed after its last event. No arrival is
    delayed by as much as the hour that events are held for, so none is late."""
    events = D.event_stream(spark, d).select(
        F.col("venue_id").alias("key"), "event_id", "ts_exchange_ns", "seq",
        (F.col("ts_exchange_ns") + F.col("qty_fp") * 100).alias("arrival"), F.lit(False).alias("flush"),
    )
    venues = D.market_events(spark, d).select(F.col("venue_id").alias("key"))
    return J.reorder_all(events, venues, 3_600_000_000_000, 1_000_000).select("key", "event_id", "release_no", "late")


@query("stream_sequencer", "K5", ME + SEQUENCER)
def _(spark, d):
    events = D.event_stream(spark, d).select(
        "venue_id", "symbol_id", "ts_ingest_ns", "event_id",
        (F.col("seq") + int_div(F.col("qty_fp"), 100_000_000)).alias("seq"), F.lit(False).alias("reset"),
    )
    return J.drain(J.sequence_gaps(events))


@query("stream_unique_events", "K6", ME + "SELECT event_id, ts_exchange_ns FROM me")
def _(spark, d):
    """Every event arrives twice."""
    twice = D.event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    log = EventLog(spark, J.new_folder(spark, "log"))
    J.for_each_batch(J.unique_events(twice, "1 hour"), J.append_unique(log))
    return log.read().select("event_id", "ts_exchange_ns")


@query(
    "stream_windows",
    "K7",
    ME
    + """, w AS (SELECT *, ts_exchange_ns // 1800000000000 * 1800000000000 - g * 1800000000000 AS s FROM me, generate_series(0, 3) AS t(g))
 SELECT s // 1000000000 AS start_s, count(*) AS n_events, round(avg(price_fp), 2) AS mid, bool_or(event_type = 3) AS fill_occurred, bool_or(event_type = 2) AS cancel_occurred
 FROM w GROUP BY s HAVING s + 7200000000000 <= ((SELECT max(ts_exchange_ns) FROM me) // 1000000 - 3600000) * 1000000""",
)
def _(spark, d):
    rows = J.drain(J.label_windows(D.event_stream(spark, d), "2 hours", "30 minutes", "1 hour"))
    return rows.select(F.unix_seconds("start").alias("start_s"), "n_events", F.round("mid", 2).alias("mid"), "fill_occurred", "cancel_occurred")


@query("stream_positions", "K8", FI.replace("WITH", "WITH RECURSIVE", 1) + POS + "SELECT * FROM final")
def _(spark, d):
    trades = D.event_stream(spark, d).filter("event_type = 3").select(
        "symbol_id", "side", int_div(F.col("price_fp"), 100).alias("price_fp"), int_div(F.col("qty_fp"), 100).alias("qty_fp"),
        F.col("ts_exchange_ns").alias("ts_ns"), "seq",
    )
    return latest_per_key(J.drain(J.positions(trades), "update"), ["symbol_id"], ["batch"]).drop("batch")


@query(
    "stream_cooldown",
    "K9",
    ME.replace("WITH", "WITH RECURSIVE", 1) + COOL + "SELECT al.event_type AS alert_type, al.seq, snt.seq IS NOT NULL AS sent FROM al LEFT JOIN snt ON al.seq = snt.seq",
)
def _(spark, d):
    alerts = D.event_stream(spark, d).select(F.col("event_type").alias("alert_type"), F.col("ts_exchange_ns").alias("ts_ns"), "seq")
    return J.drain(J.alert_cooldown(alerts, 21_600_000_000_000))


@query("stream_live_nodes", "K10")
def _(spark, d):
    nodes = D.event_stream(spark, d).select(F.concat(F.lit("sym:"), "symbol_id").alias("id"), "ts_exchange_ns")
    return J.drain(J.live_nodes(nodes))


DAY = 86_400_000_000_000
_LEAVES = "CASE WHEN kind IN (4, 5, 7) THEN created WHEN kind = 3 AND (depth = 0 OR cancel >= 1) OR kind = 2 AND depth = 0 THEN updated END"


@query(
    "stream_retention",
    "K10 I15",
    ME.replace("WITH", "WITH RECURSIVE", 1)
    + f""", si AS (SELECT 'ev:' || event_id AS id, 5 AS kind, ts_exchange_ns AS ts, seq, NULL::DOUBLE AS depth, 0 AS cancel FROM me
   UNION ALL SELECT 'trd:' || event_id, 4, ts_exchange_ns, seq, NULL, 0 FROM me WHERE event_type = 3
   UNION ALL SELECT 'ord:' || order_id_hash, 3, ts_exchange_ns, seq, CASE WHEN event_type < 2 THEN qty_fp WHEN event_type = 2 THEN 0 END, (event_type = 2)::INT FROM me WHERE event_type < 4 AND order_id_hash IS NOT NULL
   UNION ALL SELECT 'pl:' || symbol_id || ':' || venue_id || ':' || price_fp || ':' || side, 2, ts_exchange_ns, seq, CASE WHEN event_type = 4 THEN qty_fp END, 0 FROM me WHERE event_type IN (0, 4)
   UNION ALL SELECT 'sym:' || symbol_id, 0, ts_exchange_ns, seq, NULL, 0 FROM me WHERE event_type IN (0, 3, 4)),
 nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, seq) AS rn, count(*) OVER (PARTITION BY id) AS n FROM si),
 st AS (SELECT id, kind, rn, n, ts AS created, ts AS updated, coalesce(depth, 0) AS depth, cancel, NULL::BIGINT AS gone_created, NULL::BIGINT AS gone_updated, NULL::BIGINT AS gone FROM nr WHERE rn = 1
   UNION ALL SELECT id, kind, rn, n, CASE WHEN dead THEN ts ELSE created END, ts, coalesce(set_depth, CASE WHEN dead THEN 0 ELSE depth END), CASE WHEN dead THEN set_cancel ELSE greatest(cancel, set_cancel) END,
     CASE WHEN dead THEN created END, CASE WHEN dead THEN updated END, CASE WHEN dead THEN leaves + 1 END
   FROM (SELECT st.id, st.kind, nr.rn, st.n, st.created, st.updated, st.depth, st.cancel, nr.ts, nr.depth AS set_depth, nr.cancel AS set_cancel, {_LEAVES.replace("kind", "st.kind").replace("depth", "st.depth").replace("cancel", "st.cancel").replace("created", "st.created").replace("updated", "st.updated")} + {DAY} AS leaves,
     coalesce(leaves < nr.ts, false) AS dead FROM st JOIN nr ON nr.id = st.id AND nr.rn = st.rn + 1)),
 wm AS (SELECT max(ts_exchange_ns) // 1000000 - 3600000 AS ms FROM me)
 SELECT id, kind, gone_created AS created_at_ns, gone_updated AS updated_at_ns, gone AS removed_at_ns FROM st WHERE gone IS NOT NULL
 UNION ALL SELECT id, kind, created, updated, {_LEAVES} + {DAY + 1} FROM st, wm WHERE rn = n AND ({_LEAVES} + {DAY}) // 1000000 + 1 <= ms""",
)
def _(spark, d):
    """What a retention of a day lets go while the events stream in, by kind, last sight and depth."""
    return J.drain(J.removed_nodes(J.node_sights(D.event_stream(spark, d)), DAY, "1 hour"))


@query(
    "stream_latest",
    "K12",
    ME + "SELECT symbol_id, arg_max(seq, (ts_exchange_ns, seq)) AS seq, arg_max(price_fp, (ts_exchange_ns, seq)) AS price_fp, max(ts_exchange_ns) AS ts_exchange_ns FROM me GROUP BY 1",
)
def _(spark, d):
    rows = D.event_stream(spark, d).select("symbol_id", "seq", "price_fp", "ts_exchange_ns")
    changes = J.drain(J.latest(rows, ["symbol_id"], ["ts_exchange_ns", "seq"]), "update")
    return latest_per_key(changes, ["symbol_id"], ["batch"]).drop("batch")


@query("stream_decisions", "K13", PO + "SELECT seq, action_type AS type, rule FROM dc")
def _(spark, d):
    """Event -> controls -> gate -> policy, batch by batch with the batch operators."""
    out = J.new_folder(spark, "decisions")

    def write(batch, number):
        context = D.shape_context(D.shape_controls(D.with_mixing(batch)))
        decide(context).select("seq", "action.type", "action.rule").write.mode("overwrite").parquet(f"{out}/b={number}")

    J.for_each_batch(D.event_stream(spark, d), write)
    return spark.read.schema("seq bigint, type string, rule string").option("recursiveFileLookup", "true").parquet(out)


# heads of the decision stream beside those of the model: linear in the features
def register_live_heads():
    M.register_head("adversarial_drift", lambda x: (np.abs(x[:, 5]) * 4, np.abs(x[:, 6]) * 6))
    M.register_head("regime_uncertainty", lambda x: (x[:, 2] * 2, 0.4 + np.abs(x[:, 6])))
    M.register_head("cancel", lambda x: (x[:, 7] * x[:, 3] * 2, x[:, 3]))


LIVE_HEADS = [*M.HEADS, "adversarial_drift", "regime_uncertainty", "cancel"]
LIVE = (
    ME
    + """, fs AS (SELECT *, ts_exchange_ns AS ts_ns, count(*) OVER w AS n, """
    + ", ".join(f"count(*) FILTER (event_type = {k}) OVER w AS n{k}" for k in range(5))
    + """, sum(price_fp // 1000000) OVER w AS cents, sum(CASE WHEN side = 0 THEN qty_fp ELSE -qty_fp END) OVER w AS flow, sum(qty_fp) OVER w AS volume FROM me
   WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq)),
 ft AS (SELECT *, ["""
    + ", ".join(f"n{k} / n" for k in range(5))
    + """, (price_fp // 1000000 - cents / n) / greatest(cents / n, 1), flow / greatest(volume, 1), side]::DOUBLE[] AS h FROM fs)"""
    + MS.head_rows(M.HEADS, "ft", "seq", 8, 16)
    + """, mx AS (SELECT *, 0.4::DOUBLE + abs(h[7]) AS mincut, abs(h[6]) * 4 AS drift, abs(h[7]) * 6 AS cusum, h[3] * 2 AS regime_uncertainty, h[8] * h[4] * 2 AS cancel_signal, hv.* EXCLUDE (seq) FROM ft
   JOIN (SELECT seq AS hseq, """
    + ", ".join(f"max(value) FILTER (head_name = '{n}') AS {c}" for n, c in [("place", "place_signal"), ("modify", "modify_signal"), ("size", "size_signal"), ("regime_transition", "regime")])
    + """ FROM hs GROUP BY 1) hv ON hseq = seq),
 gx AS (SELECT *, NOT (mincut < [0.3, 0.5, 0.8][regime::INT + 1] OR drift > [1.5, 1.0, 0.5][regime::INT + 1] OR cusum > [5.0, 4.0, 2.0][regime::INT + 1]) AS allow_act FROM mx),
 rx AS (SELECT *, CASE WHEN NOT allow_act THEN 'coherence_gate' WHEN regime_uncertainty > 0.7 AND size_signal > 0.5 THEN 'regime_uncertainty' WHEN drift > 0.6 THEN 'adversarial_drift'
   WHEN greatest(place_signal, modify_signal, cancel_signal) < 0.1 THEN 'no_signal' END AS rule FROM gx),
 dx AS (SELECT *, CASE WHEN rule IS NOT NULL THEN 'hold' WHEN place_signal >= modify_signal AND place_signal >= cancel_signal THEN 'place' WHEN modify_signal >= cancel_signal THEN 'modify' ELSE 'cancel' END AS action_type FROM rx),
 r0 AS (SELECT *, sha256(event_id) AS input_hash, sha256(printf('fallback-no-hash%.6f', drift)) AS coherence_hash, sha256(action_type || ts_ns) AS policy_hash FROM dx WHERE rule IS NULL),
 r1 AS (SELECT *, left(sha256(input_hash || coherence_hash || policy_hash), 32) AS token_id FROM r0) """
).replace("hv.* EXCLUDE (seq)", "hv.* EXCLUDE (hseq)")


def live_layers(spark):
    return mlp_layers(spark, {n: spec[1] for n, spec in M.HEADS.items()}, 8, 16)


def live(spark, d):
    """The event table drained through the decision stream."""
    register_live_heads()
    events = D.event_stream(spark, d).withColumn("ts_ns", F.col("ts_exchange_ns"))
    return LV.DecisionStream(spark, J.new_folder(spark, "live"), live_layers(spark), LIVE_HEADS).run(events)


@query(
    "live_predictions",
    "K13",
    LIVE + f"SELECT seq, ts_ns, symbol_id, head_name, round(value, 6) AS value, round(confidence, 6) AS confidence FROM hs JOIN fs USING (seq) WHERE head_name IN {tuple(M.PREDICTION_HEADS)}",
)
def _(spark, d):
    return live(spark, d).read("predictions").withColumns({c: F.round(c, 6) for c in ("value", "confidence")})


@query("live_decisions", "K13", LIVE + "SELECT seq, ts_ns, symbol_id, flow::BIGINT AS net_qty_fp, action_type, rule, allow_act, allow_act AS allow_write FROM dx")
def _(spark, d):
    return live(spark, d).read("decisions")


@query(
    "live_receipts",
    "K13 A9",
    LIVE + "SELECT seq AS receipt_id, ts_ns, 'gnn-v1' AS model_id, input_hash, coherence_hash, policy_hash, action_type, token_id, sha256(token_id || input_hash) AS result_hash FROM r1",
)
def _(spark, d):
    return live(spark, d).read("receipts")


@query(
    "live_segments",
    "K13 A10",
    LIVE + """SELECT symbol_id, ts_ns AS start_ts_ns, ts_ns AS end_ts_ns, 'action' AS segment_kind, '{"actionType":"' || action_type || '","orderId":"o' || seq || '"}' AS metadata FROM r1 WHERE allow_act""",
)
def _(spark, d):
    return live(spark, d).read("segments")


@query(
    "stream_label_rows",
    "K7 D17",
    WIN.replace(
        f"SELECT k AS window_index, lo + k * {S} AS s, lo + k * {S} + {W} AS e FROM b, generate_series(0, 100000) AS g(k) WHERE lo + k * {S} + {W} <= hi",
        f"SELECT k AS window_index, k * {S} AS s, k * {S} + {W} AS e FROM (SELECT unnest(generate_series((lo - {W}) // {S} + 1, hi // {S})) AS k FROM b)",
    )
    + f"SELECT window_index, {rounded('mid_price_move_bp', 'slippage_bp')}, fill_occurred, cancel_occurred, vol_jump, regime_label FROM lab",
)
def _(spark, d):
    """All labels on the stream, windows aligned to the epoch."""
    labels = LV.LabelStream(spark, J.new_folder(spark, "labels"), W, S, 3_600_000_000_000)
    rows = labels.run(D.event_stream(spark, d)).finish()
    return rows.select("window_index", *R("mid_price_move_bp", "slippage_bp"), "fill_occurred", "cancel_occurred", "vol_jump", "regime_label")


@query(
    "frame_files",
    "A1",
    FR
    + """SELECT venue_id, CASE WHEN k = 1 AND event_type <> 3 THEN NULL ELSE ts_exchange_ns // 1000000 * 1000000 END AS received_at_ns, CASE WHEN k <> 2 THEN route0 ELSE 'ping' END AS kind, count(*) AS n FROM fr GROUP BY 1, 2, 3""",
)
def _(spark, d):
    """All frames written to files per venue, one per line, and read back."""
    folder = J.new_folder(spark, "frames")
    D.raw_frames(spark, d).select("data", "venue_id").write.partitionBy("venue_id").text(folder)
    frames = None
    for venue in range(3):
        part = read_frames(spark, f"{folder}/venue_id={venue}", venue, lines=True)
        frames = part if frames is None else frames.unionByName(part)
    kind = F.get_json_object("data", "$.e").alias("kind")
    return frames.groupBy("venue_id", "received_at_ns", kind).agg(F.count(F.lit(1)).alias("n"))


@query(
    "frame_array_files",
    "A1",
    FR
    + """SELECT venue_id, CASE WHEN k = 1 AND event_type <> 3 THEN NULL ELSE ts_exchange_ns // 1000000 * 1000000 END AS received_at_ns, CASE WHEN k <> 2 THEN route0 ELSE 'ping' END AS kind, count(*) AS n FROM fr GROUP BY 1, 2, 3""",
)
def _(spark, d):
    """All frames as JSON arrays of 100 or so, several to a file, read in pieces of the files."""
    folder = J.new_folder(spark, "arrays")
    frames = D.raw_frames(spark, d)
    parts = F.pmod(F.xxhash64("data"), F.ceil(frames.count() / F.lit(100)))
    arrays = frames.groupBy("venue_id", parts.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("data"), ", "), F.lit("]")).alias("value"))
    arrays.select("venue_id", "value").write.partitionBy("venue_id").text(folder)
    found = None
    for venue in range(3):
        part = read_array_frames(spark, f"{folder}/venue_id={venue}", venue).drop("file")
        found = part if found is None else found.unionByName(part)
    kind = F.get_json_object("data", "$.e").alias("kind")
    return found.groupBy("venue_id", "received_at_ns", kind).agg(F.count(F.lit(1)).alias("n"))


@query("buffered_events", "A15", ME + "SELECT event_id, ts_exchange_ns FROM me")
def _(spark, d):
    out = J.new_folder(spark, "buffered")
    rows = D.event_stream(spark, d).select("event_id", "ts_exchange_ns")
    writer = J.buffered_writer(rows, f"{out}/rows", f"{out}/checkpoint")
    writer.processAllAvailable()
    writer.stop()
    return spark.read.parquet(f"{out}/rows")


@query(
    "stream_reorder_capacity",
    "K3",
    ME + "SELECT venue_id AS key, CASE WHEN n > 200 THEN (n - 150) // 51 * 51 ELSE 0 END AS n FROM (SELECT venue_id, count(*) AS n FROM me GROUP BY 1)",
)
def _(spark, d):
    """A tolerance longer than the data: only the capacity of 200 lets events go, 51 at a time."""
    events = D.event_stream(spark, d).select(
        F.col("venue_id").alias("key"), "event_id", "ts_exchange_ns", "seq", F.col("ts_exchange_ns").alias("arrival"), F.lit(False).alias("flush")
    )
    out = J.drain(J.reorder(events, "key", 10**18, 200))
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "custom_parser_trades",
    "L5",
    ME
    + "SELECT venue_id, seq AS frame_no, symbol_id, ts_exchange_ns // 1000000 * 1000000 AS ts_exchange_ns, qty_fp AS price_fp FROM me WHERE symbol_id <> 15",
)
def _(spark, d):
    """A feed of ``time|symbol|price`` text through its own parser."""

    def parse(text):
        part = lambda i: F.split_part(text, F.lit("|"), F.lit(i))
        return F.try_parse_json(F.format_string('{"e":"trade","T":%s,"s":"%s","p":"%s","q":"1","m":false}', part(1), part(2), part(3)))

    register_parser("pipes", parse)
    e = D.market_events(spark, d)
    frames = e.select(
        "venue_id", F.col("ts_ingest_ns").alias("received_at_ns"), F.col("seq").alias("frame_no"),
        F.concat_ws("|", int_div(F.col("ts_exchange_ns"), 1_000_000), F.concat(F.lit("S"), "symbol_id"), int_div(F.col("qty_fp"), 100_000_000)).alias("data"),
    )
    rows = ingest.resolve_symbols(ingest.flatten_frames(ingest.parse_frames(frames, "pipes")), D.symbol_dimension(spark, d))
    return ingest.priced_rows(rows).select("venue_id", "frame_no", "symbol_id", "ts_exchange_ns", "price_fp")
