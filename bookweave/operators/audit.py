"""Hash columns, tokens, receipts, journals and their chain checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import fixed_text, sha256_of
from bookweave.operators.ordered import count_of, fold_in_rounds, lag_of, running
from bookweave.session import cut_lineage


def coherence_text() -> Column:
    """Canonical text of a coherence decision row, numbers with six decimals."""
    parts = [
        ("allow_retrieve", F.col("allow_retrieve").cast("string")),
        ("allow_write", F.col("allow_write").cast("string")),
        ("allow_learn", F.col("allow_learn").cast("string")),
        ("allow_act", F.col("allow_act").cast("string")),
        ("mincut", F.col("mincut_value").cast("string")),
        ("partition", F.col("partition_hash")),
        ("drift", fixed_text(F.col("drift_score"))),
        ("cusum", fixed_text(F.col("cusum_score"))),
        ("reasons", F.array_join("reasons", ",")),
    ]
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}:"), v) for n, v in parts])


def policy_input_text() -> Column:
    """Canonical text of a policy input row. ``controls`` is an array of (head_name, value,
    confidence)."""
    controls = F.transform(
        "controls",
        lambda c: F.concat_ws(":", c["head_name"], fixed_text(c["value"]), fixed_text(c["confidence"])),
    )
    parts = [
        ("ts", F.col("ts_ns").cast("string")),
        ("coherence", coherence_text()),
        ("model_ts", F.col("model_ts_ns").cast("string")),
        ("predictions", F.col("n_predictions").cast("string")),
        ("controls", F.array_join(controls, ",")),
        ("position", F.concat_ws(":", F.col("symbol_id"), F.col("net_qty_fp"))),
        ("venue", F.concat_ws(":", F.col("venue_id"), F.col("venue_halted"), F.col("venue_healthy"))),
    ]
    return F.concat_ws("||", *[F.concat(F.lit(f"{n}:"), v) for n, v in parts])


def action_text(action: str = "action") -> Column:
    """Canonical text of an action struct."""
    a = F.col(action)
    return (
        F.when(a["type"] == "place", F.concat_ws(":", F.lit("place"), a["symbol_id"], a["side"], a["qty_fp"], a["order_type"]))
        .when(a["type"] == "modify", F.lit("modify::none:none"))
        .when(a["type"] == "cancel", F.concat(F.lit("cancel::"), a["detail"]))
        .when(a["type"] == "hold", F.concat_ws(":", F.lit("hold"), a["rule"], a["detail"]))
        .when(a["type"] == "throttle", F.concat_ws(":", F.lit("throttle"), a["resume_after_ns"], a["detail"]))
        .otherwise(F.concat(F.lit("emergency_flatten:"), a["detail"]))
    )


def mint_tokens(decided: DataFrame, order: list[str]) -> DataFrame:
    """Token columns. The counter is the row's rank in the whole event order."""
    hashed = decided.withColumns(
        {
            "coherence_hash": F.sha2(coherence_text(), 256),
            "policy_hash": F.sha2(policy_input_text(), 256),
            "action_intent": action_text(),
        }
    )
    # the context behind these columns is dear and the running count reads its input more than once
    counted = running(cut_lineage(hashed), [], order, _n=count_of()).drop("_chunk")
    token = F.sha2(
        F.concat_ws(":", "coherence_hash", "policy_hash", "action_intent", F.col("_n"), F.col("ts_ns")), 256
    )
    return counted.withColumn("token_id", token).drop("_n")


def token_check(tokens: DataFrame, now_ns: Column, expected_hash: Column, max_age_ns: int = 100_000_000) -> DataFrame:
    """Stale tokens first, then tokens bound to another coherence decision."""
    age = now_ns - F.col("ts_ns")
    reason = F.when(
        age > max_age_ns, F.format_string(f"Token is stale: age %dns > max {max_age_ns}ns", age)
    ).when(
        F.col("coherence_hash") != expected_hash, F.lit("Coherence hash mismatch -- decision may have changed")
    )
    return tokens.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def receipts(acted: DataFrame, model_id: str, *keep: str) -> DataFrame:
    """Receipt columns of acted events (event_id, ts_ns, action_type, partition_hash, drift_score), after the
    columns to keep."""
    base = acted.withColumns(
        {
            "input_hash": sha256_of(F.col("event_id")),
            "coherence_hash": sha256_of(F.col("partition_hash"), fixed_text(F.col("drift_score"))),
            "policy_hash": sha256_of(F.col("action_type"), F.col("ts_ns")),
        }
    )
    token = F.substring(sha256_of(*[F.col(c) for c in ("input_hash", "coherence_hash", "policy_hash")]), 1, 32)
    with_token = base.withColumn("token_id", token)
    return with_token.select(
        *keep,
        "ts_ns",
        F.lit(model_id).alias("model_id"),
        "input_hash",
        "coherence_hash",
        "policy_hash",
        "action_type",
        "token_id",
        sha256_of(F.col("token_id"), F.col("input_hash")).alias("result_hash"),
    )


def receipt_links(receipts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each receipt with whether its input hash follows from the one before (true for the first)."""
    rows = running(receipts, keys, order, _prev=lag_of(F.struct("result_hash", "coherence_hash")))
    prev = F.col("_prev.v")
    expected = sha256_of(prev["result_hash"], prev["coherence_hash"])
    return rows.withColumn("link_ok", F.coalesce(F.col("input_hash") == expected, F.lit(True))).drop("_prev", "_chunk")


def receipt_chain_valid(receipts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    links = receipt_links(receipts, keys, order)
    result = F.coalesce(F.bool_and("link_ok"), F.lit(True)).alias("valid")
    return links.groupBy(*keys).agg(result) if keys else links.agg(result)


def fill_text() -> Column:
    """Canonical text of a fill report row (fill_type, price_fp, qty_fp, remaining_qty_fp, reject_reason, ts_ns)."""
    kind = F.col("fill_type")
    return (
        F.when(kind == "filled", F.concat_ws(":", kind, "price_fp", "qty_fp", "ts_ns"))
        .when(kind == "partial_fill", F.concat_ws(":", kind, "price_fp", "qty_fp", "remaining_qty_fp", "ts_ns"))
        .when(kind == "rejected", F.concat_ws(":", kind, "reject_reason", "ts_ns"))
        .otherwise(F.concat_ws(":", F.lit("cancelled"), "ts_ns"))
    )


def link_text() -> Column:
    """What a journal link hashes after the previous hash."""
    return F.concat(fill_text(), F.col("token_id"), F.col("position_hash"), F.col("recorded_at_ns").cast("string"))


def _chain_step(rows, before):
    previous = before["chain_hash"] if before else "genesis"
    out = []
    for at, seq, text in zip(rows.recorded_at_ns, rows.seq, rows.text):
        previous = hashlib.sha256((previous + text).encode()).hexdigest()
        out.append((int(at), int(seq), previous))
    return out, {"chain_hash": previous}


def build_journal(journal: DataFrame, key: str, rows_per_round: int = 1_000_000) -> DataFrame:
    """Chain hashes of every journal: each hash needs the one before, so this is a sequential fold per
    journal in bounded rounds; journals run side by side."""
    texts = journal.select(key, "recorded_at_ns", "seq", link_text().alias("text"))
    hashes, _ = fold_in_rounds(
        texts, [key], ["recorded_at_ns", "seq"], _chain_step, ["chain_hash"],
        "recorded_at_ns bigint, seq bigint, chain_hash string", rows_per_round,
    )
    return journal.join(hashes, [key, "recorded_at_ns", "seq"])


def journal_links(journal: DataFrame, key: str) -> DataFrame:
    """Recompute every hash from the stored one before it (``genesis`` at first): fully parallel."""
    rows = running(journal, [key], ["recorded_at_ns", "seq"], _prev=lag_of(F.col("chain_hash")))
    expected = F.sha2(F.concat(F.coalesce("_prev.v", F.lit("genesis")), link_text()), 256)
    return rows.withColumn("link_ok", F.col("chain_hash") == expected).drop("_prev", "_chunk")


def journal_valid(journal: DataFrame, key: str) -> DataFrame:
    return journal_links(journal, key).groupBy(key).agg(F.bool_and("link_ok").alias("valid"))


def entries_between(journal: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Inclusive at both ends."""
    return journal.filter(F.col("recorded_at_ns").between(start_ns, end_ns))


def receipts_between(receipts: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    ts = F.col("ts_ns")
    return receipts.filter((ts >= start_ns) & (ts < end_ns)).orderBy("ts_ns", "receipt_id")


def receipts_of_model(receipts: DataFrame, model_id: str) -> DataFrame:
    return receipts.filter(F.col("model_id") == model_id).orderBy("ts_ns", "receipt_id")


def positions_hash(positions: DataFrame, book: str | None = None) -> DataFrame:
    """sha256 of all positions in symbol order, joined without a separator, per book.

    One short text per symbol of a book: the set is the book's position table (one row per symbol),
    not its fills.
    """
    text = F.concat_ws(":", "symbol_id", "net_qty_fp", "avg_entry_price_fp", "realized_pnl_fp")
    entries = F.array_sort(F.collect_list(F.struct("symbol_id", text.alias("t"))))
    joined = F.array_join(F.transform(entries, lambda e: e["t"]), "")
    result = F.sha2(joined, 256).alias("state_hash")
    return positions.groupBy(book).agg(result) if book else positions.agg(result)


def action_segments(acted: DataFrame) -> DataFrame:
    """One ``action`` segment per executed decision that the gate lets write."""
    return acted.filter(F.col("allow_write")).select(
        "symbol_id",
        F.col("ts_ns").alias("start_ts_ns"),
        F.col("ts_ns").alias("end_ts_ns"),
        F.lit("action").alias("segment_kind"),
        F.to_json(F.struct(F.col("action_type").alias("actionType"), F.col("order_id").alias("orderId"))).alias("metadata"),
    )


def split_by_gate(segments: DataFrame, decisions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(segments to write, blocked segments) by their decision's allow_write."""
    joined = segments.join(decisions.select(*keys, "allow_write"), keys)
    return joined.filter("allow_write").drop("allow_write"), joined.filter(~F.col("allow_write")).drop("allow_write")
