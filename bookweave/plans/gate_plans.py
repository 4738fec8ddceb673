"""Gate, policy and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookweave.functions.scalars import level_key, order_key, sha256_of, symbol_key, time_bucket_key, venue_key
from bookweave.operators import audit as A
from bookweave.operators import gate as G
from bookweave.operators import pnl as P
from bookweave.plans.catalog import query
from bookweave.plans.pnl_plans import FI, POS
from bookweave.sources.driver_tables import ME_SQL, POLICY_SQL, control_rows, fills, market_events, model_events, policy_context

ME = f"WITH {ME_SQL} "
PO = f"WITH {POLICY_SQL} "
KEYS = ["seq", "ts_ns", "symbol_id", "venue_id", "z"]


@query("coherence_metrics", "B19", PO + "SELECT seq, mincut, drift, cusum FROM ctx")
def _(spark, d):
    return G.coherence_metrics(control_rows(spark, d), ["seq"]).select("seq", "mincut", "drift", "cusum")


@query(
    "coherence_gate",
    "B18",
    PO + "SELECT seq, allow_act, allow_write, true AS allow_retrieve, true AS allow_learn, mincut_value, array_to_string(reasons, '; ') AS reasons FROM ctx",
)
def _(spark, d):
    return policy_context(spark, d).select(
        "seq", "allow_act", "allow_write", "allow_retrieve", "allow_learn", "mincut_value", F.array_join("reasons", "; ").alias("reasons")
    )


RULE_COLUMNS = {
    "kill_switch_rule": ("B20", "kill_switch", G.kill_switch_rule, "kill_active"),
    "venue_health_rule": ("B20", "venue_health", G.venue_rule, "venue_halted OR NOT venue_healthy"),
    "coherence_rule": ("B21", "coherence_gate", G.coherence_rule, "NOT allow_act"),
    "regime_uncertainty_rule": ("B22", "regime_uncertainty", G.regime_rule, "regime_uncertainty > 0.7 AND size_signal > 0.5"),
    "adversarial_drift_rule": ("B23", "adversarial_drift", G.drift_rule, "adversarial_drift > 0.6"),
    "slippage_rule": ("B24", "slippage_drift", G.slippage_rule, "slippage_bp > 5"),
    "rate_throttle_rule": ("B25", "rate_throttle", G.throttle_rule, "order_rate_ratio > 0.9 OR cancel_rate_ratio > 0.9"),
}


def _add_rule(name, ids, label, rule, condition):
    sql = PO + f"SELECT seq, '{label}' AS rule, CASE WHEN '{label}' = 'rate_throttle' THEN ts_ns + 1000000000 END AS resume_after_ns FROM ctx WHERE {condition}"

    @query(name, ids, sql)
    def _(spark, d):
        found = policy_context(spark, d).withColumn("action", rule()).filter(F.col("action").isNotNull())
        return found.select("seq", "action.rule", "action.resume_after_ns")


for _name, (_ids, _label, _rule, _condition) in RULE_COLUMNS.items():
    _add_rule(_name, _ids, _label, _rule, _condition)


@query(
    "signal_actions",
    "B26",
    PO
    + """SELECT seq, CASE WHEN greatest(place_signal, modify_signal, cancel_signal) < 0.1 THEN 'hold' WHEN place_signal >= modify_signal AND place_signal >= cancel_signal THEN 'place'
 WHEN modify_signal >= cancel_signal THEN 'modify' ELSE 'cancel' END AS type FROM ctx""",
)
def _(spark, d):
    return policy_context(spark, d).select("seq", G.signal_action()["type"].alias("type"))


@query(
    "order_intents",
    "B27",
    PO + "SELECT seq, a_side AS side, a_qty AS qty_fp, ot AS order_type, CASE WHEN ot = 'ioc' THEN 'fok' ELSE 'day' END AS time_in_force FROM ru",
)
def _(spark, d):
    a = G.order_intent()
    return policy_context(spark, d).withColumn("a", a).select("seq", "a.side", "a.qty_fp", "a.order_type", "a.time_in_force")


@query("policy_decisions", "B28 L3 C16", PO + "SELECT seq, action_type AS type, rule, coalesce(detail, CASE action_type WHEN 'modify' THEN '' WHEN 'cancel' THEN 'Model cancel signal triggered' END) AS detail FROM dc")
def _(spark, d):
    return G.decide(policy_context(spark, d)).select("seq", "action.type", "action.rule", "action.detail")


@query(
    "policy_with_custom_rule",
    "L3",
    PO
    + """SELECT seq, CASE WHEN rule = 'no_signal' OR rule IS NULL THEN CASE WHEN symbol_id = 4 THEN 'symbol_ban' ELSE rule END ELSE rule END AS rule FROM dc""",
)
def _(spark, d):
    ban = ("symbol_ban", lambda: F.when(F.col("symbol_id") == 4, G.hold("symbol_ban", F.lit("banned"))))
    return G.decide(policy_context(spark, d), [ban]).select("seq", "action.rule")


MULT = "greatest(0, least(1, 1 / (1 + exp(5 * (drift - 0.5))) * greatest(0, 1 - 0.5 * cusum) * CASE WHEN z % 4 <> 0 THEN 1.0 ELSE 0.8 END))"


@query("confidence_multiplier", "B29", PO + f"SELECT seq, round({MULT}, 9) AS m FROM ctx")
def _(spark, d):
    rows = policy_context(spark, d)
    m = G.confidence_multiplier(F.col("drift_score"), F.col("cusum_score"), F.col("z") % 4 != 0)
    return rows.select("seq", F.round(m, 9).alias("m"))


@query(
    "gated_ensemble",
    "B30",
    PO
    + f""", c AS (SELECT *, {MULT} AS m FROM ctx)
 SELECT seq, 'regime_uncertainty' AS head_name, round(mincut * m, 9) AS confidence FROM c WHERE z % 2 = 0
 UNION ALL SELECT seq, 'regime_uncertainty', round(CASE WHEN allow_act THEN mincut * m ELSE 0 END, 9) FROM c WHERE z % 2 <> 0
 UNION ALL SELECT seq, 'adversarial_drift', round(cusum * m, 9) FROM c WHERE z % 2 = 0
 UNION ALL SELECT seq, 'adversarial_drift', round(CASE WHEN allow_act THEN cusum * m ELSE 0 END, 9) FROM c WHERE z % 2 <> 0
 UNION ALL SELECT seq, h, round(CASE WHEN z % 2 = 0 OR allow_act THEN 0.9 * m ELSE 0 END, 9) FROM c, (SELECT unnest(['place', 'modify', 'cancel', 'side', 'size', 'urgency']) AS h)""",
)
def _(spark, d):
    signals = control_rows(spark, d).withColumn("signal_kind", F.when(F.col("z") % 2 == 0, "prediction").otherwise("control"))
    decisions = policy_context(spark, d).withColumn("allow_learn", F.col("z") % 4 != 0)
    out = G.gate_ensemble(signals.drop("ts_ns", "symbol_id", "venue_id", "z"), decisions, ["seq"])
    return out.select("seq", "head_name", F.round("confidence", 9).alias("confidence"))


@query(
    "latest_state_at_event",
    "C15",
    ME
    + """SELECT seq, ls AS known_seq, lp AS known_price FROM (SELECT *, last_value(CASE WHEN event_type = 4 THEN seq END IGNORE NULLS) OVER w AS ls, last_value(CASE WHEN event_type = 4 THEN price_fp END IGNORE NULLS) OVER w AS lp
 FROM me WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq)) WHERE event_type = 3""",
)
def _(spark, d):
    e = market_events(spark, d).withColumn("ts_ns", F.col("ts_exchange_ns"))
    states = e.filter("event_type = 4").select("symbol_id", "ts_ns", "seq", F.col("seq").alias("known_seq"), F.col("price_fp").alias("known_price"))
    trades = e.filter("event_type = 3").select("symbol_id", "ts_ns", "seq")
    return G.as_of(trades, states, ["symbol_id"], "ts_ns", "seq", ["known_seq", "known_price"]).select("seq", "known_seq", "known_price")


@query(
    "decision_context",
    "C16",
    ME
    + """, x AS (SELECT *, sum(CASE WHEN event_type = 3 THEN CASE WHEN side = 0 THEN qty_fp // 100 ELSE -(qty_fp // 100) END ELSE 0 END) OVER (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq) AS net,
   last_value(CASE WHEN event_type = 4 THEN price_fp END IGNORE NULLS) OVER (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq) AS known_price,
   last_value(CASE WHEN event_type = 2 THEN side END IGNORE NULLS) OVER (PARTITION BY venue_id ORDER BY ts_exchange_ns, seq) AS venue_flag FROM me)
 SELECT seq, CAST(CASE WHEN EXISTS (SELECT 1 FROM me m WHERE m.symbol_id = x.symbol_id AND m.event_type = 3 AND m.ts_exchange_ns <= x.ts_exchange_ns) THEN net END AS BIGINT) AS net_qty_fp, known_price, venue_flag FROM x WHERE event_type = 0""",
)
def _(spark, d):
    """Position, last snapshot price and last venue flag known at every new order."""
    e = market_events(spark, d).withColumn("ts_ns", F.col("ts_exchange_ns"))
    net = P.net_quantities(fills(spark, d)).select("symbol_id", "ts_ns", "seq", "net_qty_fp")
    prices = e.filter("event_type = 4").select("symbol_id", "ts_ns", "seq", F.col("price_fp").alias("known_price"))
    flags = e.filter("event_type = 2").select("venue_id", "ts_ns", "seq", F.col("side").alias("venue_flag"))
    orders = e.filter("event_type = 0").select("symbol_id", "venue_id", "ts_ns", "seq")
    out = G.decision_context(
        orders, [(net, ["symbol_id"], ["net_qty_fp"]), (prices, ["symbol_id"], ["known_price"]), (flags, ["venue_id"], ["venue_flag"])]
    )
    return out.select("seq", "net_qty_fp", "known_price", "venue_flag")


# --- audit ---------------------------------------------------------------------------------------------


@query("sha256_text", "H1", ME + "SELECT seq, sha256(event_id || ':' || price_fp) AS h FROM me")
def _(spark, d):
    return market_events(spark, d).select("seq", sha256_of(F.col("event_id"), F.lit(":"), F.col("price_fp")).alias("h"))


@query(
    "domain_keys",
    "H5",
    ME
    + """SELECT seq, 'pl:' || symbol_id || ':' || venue_id || ':' || price_fp || ':' || side AS level, 'sym:' || symbol_id AS symbol, 'ven:' || venue_id AS venue,
 'ord:' || order_id_hash AS ord, 'tb:' || symbol_id || ':' || ts_exchange_ns AS bucket FROM me""",
)
def _(spark, d):
    c = F.col
    return market_events(spark, d).select(
        "seq",
        level_key(c("symbol_id"), c("venue_id"), c("price_fp"), c("side")).alias("level"),
        symbol_key(c("symbol_id")).alias("symbol"),
        venue_key(c("venue_id")).alias("venue"),
        order_key(c("order_id_hash")).alias("ord"),
        time_bucket_key(c("symbol_id"), c("ts_exchange_ns")).alias("bucket"),
    )


TEXT = """, tx AS (SELECT *, concat_ws('|', 'allow_retrieve:true', 'allow_write:' || allow_write, 'allow_learn:true', 'allow_act:' || allow_act, 'mincut:' || mincut_value,
   'partition:fallback-no-hash', printf('drift:%.6f', drift), printf('cusum:%.6f', cusum), 'reasons:' || array_to_string(reasons, ',')) AS coherence_text FROM dc),
 t2 AS (SELECT *, concat_ws('||', 'ts:' || ts_ns, 'coherence:' || coherence_text, 'model_ts:' || ts_ns, 'predictions:6',
   printf('controls:place:%.6f:0.900000,size:%.6f:0.900000', place_signal, size_signal), 'position:' || symbol_id || ':' || qty_fp, 'venue:' || venue_id || ':' || venue_halted || ':' || venue_healthy) AS input_text,
   CASE action_type WHEN 'place' THEN 'place:' || symbol_id || ':' || a_side || ':' || a_qty || ':' || ot WHEN 'modify' THEN 'modify::none:none' WHEN 'cancel' THEN 'cancel::Model cancel signal triggered'
     WHEN 'hold' THEN 'hold:' || rule || ':' || detail WHEN 'throttle' THEN 'throttle:' || (ts_ns + 1000000000) || ':' || detail END AS action_text FROM tx) """


def _decided(spark, d):
    rows = G.decide(policy_context(spark, d))
    head = lambda n, c: F.struct(F.lit(n).alias("head_name"), F.col(c).alias("value"), F.lit(0.9).alias("confidence"))
    return rows.withColumns(
        {
            "controls": F.array(head("place", "place_signal"), head("size", "size_signal")),
            "model_ts_ns": F.col("ts_ns"),
            "n_predictions": F.lit(6),
        }
    ).join(market_events(spark, d).select("seq", "event_id", F.col("qty_fp").alias("net_qty_fp")), "seq")


@query("canonical_texts", "H2", PO + TEXT + "SELECT seq, coherence_text, input_text, action_text FROM t2")
def _(spark, d):
    return _decided(spark, d).select(
        "seq", A.coherence_text().alias("coherence_text"), A.policy_input_text().alias("input_text"), A.action_text().alias("action_text")
    )


TOKEN = """, tk AS (SELECT *, sha256(coherence_text) AS coherence_hash, sha256(input_text) AS policy_hash, row_number() OVER (ORDER BY ts_ns, seq) AS n FROM t2) """


@query(
    "minted_tokens",
    "H3",
    PO + TEXT + TOKEN + "SELECT seq, coherence_hash, policy_hash, sha256(concat_ws(':', coherence_hash, policy_hash, action_text, n, ts_ns)) AS token_id FROM tk",
)
def _(spark, d):
    return A.mint_tokens(_decided(spark, d), ["ts_ns", "seq"]).select("seq", "coherence_hash", "policy_hash", "token_id")


@query(
    "token_check",
    "B34",
    PO
    + TEXT
    + """SELECT seq, CASE WHEN z * 2000000 > 100000000 THEN 'Token is stale: age ' || (z * 2000000) || 'ns > max 100000000ns' WHEN z % 7 = 0 THEN 'Coherence hash mismatch -- decision may have changed' END AS reason,
 NOT (z * 2000000 > 100000000 OR z % 7 = 0) AS valid FROM t2""",
)
def _(spark, d):
    """Tokens checked z x 2 ms later; every z divisible by 7 has another decision by then."""
    rows = policy_context(spark, d).withColumn("coherence_hash", F.sha2(A.coherence_text(), 256))
    expected = F.when(F.col("z") % 7 == 0, F.lit("changed")).otherwise(F.col("coherence_hash"))
    return A.token_check(rows, F.col("ts_ns") + F.col("z") * 2_000_000, expected).select("seq", "reason", "valid")


RECEIPT = """, rc0 AS (SELECT *, sha256(event_id) AS input_hash, sha256(printf('fallback-no-hash%.6f', drift)) AS coherence_hash, sha256(action_type || ts_ns) AS policy_hash FROM dc WHERE action_type IN ('place', 'modify', 'cancel')),
 rc1 AS (SELECT *, left(sha256(input_hash || coherence_hash || policy_hash), 32) AS token_id FROM rc0),
 rc AS (SELECT seq AS receipt_id, ts_ns, 'gnn-v1' AS model_id, input_hash, coherence_hash, policy_hash, action_type, token_id, sha256(token_id || input_hash) AS result_hash, symbol_id, allow_write FROM rc1) """
RC_COLS = "ts_ns, model_id, input_hash, coherence_hash, policy_hash, action_type, token_id, result_hash"


def acted(spark, d):
    rows = _decided(spark, d).withColumn("action_type", F.col("action.type"))
    return rows.filter(F.col("action_type").isin("place", "modify", "cancel"))


@query("receipts", "A9", PO + RECEIPT + f"SELECT {RC_COLS} FROM rc")
def _(spark, d):
    return A.receipts(acted(spark, d), "gnn-v1")


def receipt_table(spark, d):
    return A.receipts(acted(spark, d).withColumn("receipt_id", F.col("seq")), "gnn-v1", "receipt_id")


T0, T1 = 1_704_499_200_000_000_000, 1_705_363_200_000_000_000


@query("receipts_by_time", "B12", PO + RECEIPT + f"SELECT receipt_id, {RC_COLS} FROM rc WHERE ts_ns >= {T0} AND ts_ns < {T1}")
def _(spark, d):
    return A.receipts_between(receipt_table(spark, d), T0, T1)


@query("receipts_by_model", "B13", PO + RECEIPT + f"SELECT receipt_id, {RC_COLS} FROM rc WHERE model_id = 'gnn-v1'")
def _(spark, d):
    return A.receipts_of_model(receipt_table(spark, d), "gnn-v1")


@query("recent_receipts", "F5", PO + RECEIPT + "SELECT receipt_id, ts_ns, token_id FROM rc ORDER BY ts_ns DESC, receipt_id DESC LIMIT 100")
def _(spark, d):
    return receipt_table(spark, d).orderBy(F.desc("ts_ns"), F.desc("receipt_id")).limit(100).select("receipt_id", "ts_ns", "token_id")


@query(
    "action_segments",
    "A10 H21",
    PO + RECEIPT + """SELECT symbol_id, ts_ns AS start_ts_ns, ts_ns AS end_ts_ns, 'action' AS segment_kind, '{"actionType":"' || action_type || '","orderId":"o' || receipt_id || '"}' AS metadata FROM rc WHERE allow_write""",
)
def _(spark, d):
    return A.action_segments(acted(spark, d).withColumn("order_id", F.concat(F.lit("o"), "seq")))


@query("gated_segments", "A8", PO + "SELECT allow_write AS written, count(*) AS n, min(seq) AS first_seq FROM ctx GROUP BY 1")
def _(spark, d):
    segments = model_events(spark, d).select("seq", "symbol_id", F.col("ts_ns").alias("start_ts_ns"))
    kept, blocked = A.split_by_gate(segments, policy_context(spark, d), ["seq"])
    both = kept.withColumn("written", F.lit(True)).unionByName(blocked.withColumn("written", F.lit(False)))
    return both.groupBy("written").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


CHAIN = """, r0 AS (SELECT symbol_id, ts_exchange_ns, seq, qty_fp, sha256(event_id) AS result_hash, sha256(CAST(seq AS VARCHAR)) AS coherence_hash FROM me),
 r1 AS (SELECT *, CASE WHEN qty_fp = 1200000000 THEN 'tampered' ELSE coalesce(sha256(lag(result_hash) OVER w || lag(coherence_hash) OVER w), 'first') END AS input_hash FROM r0 WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq)),
 r2 AS (SELECT *, coalesce(input_hash = sha256(lag(result_hash) OVER w || lag(coherence_hash) OVER w), true) AS link_ok FROM r1 WINDOW w AS (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq)) """


def chained_receipts(spark, d):
    """Receipts built as a proper chain per symbol; those with quantity 12 are altered afterwards."""
    from bookweave.operators.ordered import lag_of, running

    base = market_events(spark, d).select(
        "symbol_id", "ts_exchange_ns", "seq", "qty_fp",
        sha256_of(F.col("event_id")).alias("result_hash"), sha256_of(F.col("seq")).alias("coherence_hash"),
    )
    rows = running(base, ["symbol_id"], ["ts_exchange_ns", "seq"], p=lag_of(F.struct("result_hash", "coherence_hash")))
    linked = F.coalesce(sha256_of(F.col("p.v.result_hash"), F.col("p.v.coherence_hash")), F.lit("first"))
    return rows.withColumn("input_hash", F.when(F.col("qty_fp") == 1_200_000_000, "tampered").otherwise(linked)).drop("p")


@query("receipt_links", "E19", ME + CHAIN + "SELECT seq, link_ok FROM r2")
def _(spark, d):
    return A.receipt_links(chained_receipts(spark, d), ["symbol_id"], ["ts_exchange_ns", "seq"]).select("seq", "link_ok")


@query("receipt_chain_valid", "E19", ME + CHAIN + "SELECT symbol_id, bool_and(link_ok) AS valid FROM r2 GROUP BY 1")
def _(spark, d):
    return A.receipt_chain_valid(chained_receipts(spark, d), ["symbol_id"], ["ts_exchange_ns", "seq"])


FT = """, jn AS (SELECT symbol_id, seq, ts_exchange_ns AS recorded_at_ns, qty_fp, CASE (qty_fp // 100000000) % 4
   WHEN 0 THEN 'filled:' || price_fp || ':' || qty_fp || ':' || ts_exchange_ns WHEN 1 THEN 'partial_fill:' || price_fp || ':' || qty_fp || ':' || (qty_fp * 2) || ':' || ts_exchange_ns
   WHEN 2 THEN 'rejected:too late:' || ts_exchange_ns ELSE 'cancelled:' || ts_exchange_ns END AS fill_text, event_id AS token_id, md5(event_id) AS position_hash,
   row_number() OVER (PARTITION BY symbol_id ORDER BY ts_exchange_ns, seq) AS rn FROM me WHERE event_type = 3),
 ch AS (WITH RECURSIVE c AS (
   SELECT symbol_id, CAST(0 AS BIGINT) AS rn, 'genesis' AS chain_hash FROM (SELECT DISTINCT symbol_id FROM jn)
   UNION ALL SELECT c.symbol_id, jn.rn, sha256(c.chain_hash || fill_text || token_id || position_hash || recorded_at_ns) FROM c JOIN jn ON jn.symbol_id = c.symbol_id AND jn.rn = c.rn + 1)
   SELECT * FROM c),
 jo AS (SELECT jn.*, chain_hash FROM jn JOIN ch ON jn.symbol_id = ch.symbol_id AND jn.rn = ch.rn),
 ta AS (SELECT *, CASE WHEN qty_fp = 1200000000 THEN md5('x') ELSE chain_hash END AS stored FROM jo),
 lk AS (SELECT *, stored = sha256(coalesce(lag(stored) OVER (PARTITION BY symbol_id ORDER BY rn), 'genesis') || fill_text || token_id || position_hash || recorded_at_ns) AS link_ok FROM ta) """
MER = ME.replace("WITH", "WITH RECURSIVE", 1)


def journal(spark, d):
    kind = F.pmod((F.col("qty_fp") / 100_000_000).cast("int"), F.lit(4))
    return market_events(spark, d).filter("event_type = 3").select(
        "symbol_id", "seq", F.col("ts_exchange_ns").alias("ts_ns"), F.col("ts_exchange_ns").alias("recorded_at_ns"), "price_fp", "qty_fp",
        (F.col("qty_fp") * 2).alias("remaining_qty_fp"), F.lit("too late").alias("reject_reason"),
        F.when(kind == 0, "filled").when(kind == 1, "partial_fill").when(kind == 2, "rejected").otherwise("cancelled").alias("fill_type"),
        F.col("event_id").alias("token_id"), F.md5("event_id").alias("position_hash"),
    )


@query("fill_texts", "H4", ME + FT.split(" ch AS")[0].rstrip().rstrip(",") + " SELECT seq, fill_text FROM jn")
def _(spark, d):
    return journal(spark, d).select("seq", A.fill_text().alias("fill_text"))


@query("journal_chain", "E21", MER + FT + "SELECT seq, chain_hash FROM jo")
def _(spark, d):
    return A.build_journal(journal(spark, d), "symbol_id").select("seq", "chain_hash")


def stored_journal(spark, d):
    built = A.build_journal(journal(spark, d), "symbol_id")
    return built.withColumn("chain_hash", F.when(F.col("qty_fp") == 1_200_000_000, F.md5(F.lit("x"))).otherwise(F.col("chain_hash")))


@query("journal_links", "E20", MER + FT + "SELECT seq, link_ok FROM lk")
def _(spark, d):
    return A.journal_links(stored_journal(spark, d), "symbol_id").select("seq", "link_ok")


@query("journal_valid", "E20", MER + FT + "SELECT symbol_id, bool_and(link_ok) AS valid FROM lk GROUP BY 1")
def _(spark, d):
    return A.journal_valid(stored_journal(spark, d), "symbol_id")


@query("journal_between", "B14", ME + FT.split(" ch AS")[0].rstrip().rstrip(",") + f" SELECT seq, recorded_at_ns FROM jn WHERE recorded_at_ns BETWEEN {T0} AND {T1}")
def _(spark, d):
    return A.entries_between(journal(spark, d), T0, T1).select("seq", "recorded_at_ns")


@query(
    "positions_hash",
    "D36",
    FI.replace("WITH", "WITH RECURSIVE", 1)
    + POS
    + "SELECT sha256(string_agg(concat_ws(':', symbol_id, net_qty_fp, avg_entry_price_fp, realized_pnl_fp), '' ORDER BY symbol_id)) AS state_hash FROM final",
)
def _(spark, d):
    return A.positions_hash(P.positions(fills(spark, d)))
