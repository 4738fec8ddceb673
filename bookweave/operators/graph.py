"""Events folded into a property graph, set-wise: node and edge tables instead of a mutable store.

Ids are strings built from keys: ``sym:``, ``ven:``, ``pl:`` for structural nodes and
``ord:``/``trd:``/``ev:``/``tb:``/``rg:`` plus the event id for nodes an event creates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import level_key, order_key, symbol_key, venue_key
from bookweave.operators.ordered import count_of, last_of, reflected_sum, running, sum_of
from bookweave.schemas import EDGE, EVENT, NODE, PROP

ORDER = ["ts_exchange_ns", "seq"]


def _is(*names: str) -> Column:
    return F.col("event_type").isin(*[EVENT[n] for n in names])


def own_level() -> Column:
    return level_key(F.col("symbol_id"), F.col("venue_id"), F.col("price_fp"), F.coalesce("side", F.lit(0)))


def with_orders(events: DataFrame) -> DataFrame:
    """Every event with the order it refers to: the latest NewOrder of the same hash before it (an
    as-of lookup as a running last value), that order's level, and its depth just before the event.

    Order depth is set by New, Modify and Cancel and lowered by trades, floored at 0. Trades only
    lower it, so depth = max(0, last set value - traded since), from one running sum.
    """
    slim = events.select(
        "event_id", *ORDER, "venue_id", "symbol_id", "event_type", "side", "price_fp", "qty_fp",
        "order_id_hash", "flags",
    ).withColumn("level", own_level())
    can_refer = F.col("order_id_hash").isNotNull() & _is("NewOrder", "ModifyOrder", "CancelOrder", "Trade")
    traded = F.when(_is("Trade"), F.col("qty_fp")).otherwise(F.lit(0).cast("bigint"))
    opened = F.when(_is("NewOrder"), F.struct(F.col("event_id").alias("order_event"), "level"))
    rows = slim
    hashed = running(
        rows.filter(can_refer), ["order_id_hash"], ORDER, known=last_of(opened), _traded=sum_of(traded)
    )
    known = F.col("known").isNotNull()
    set_to = F.when(
        _is("NewOrder") | (_is("ModifyOrder") & known), F.col("qty_fp")
    ).when(_is("CancelOrder") & known, F.lit(0).cast("bigint"))
    setter = F.when(set_to.isNotNull(), F.struct(set_to.alias("q"), F.col("_traded").alias("s")))
    hashed = running(hashed, ["order_id_hash"], ORDER, _set=last_of(setter))
    since = F.col("_traded") - traded - F.col("_set.s")
    hashed = hashed.withColumn(
        "order_depth", F.when(known, F.greatest(F.lit(0).cast("bigint"), F.col("_set.q") - since))
    ).drop("_set", "_traded", "_chunk")
    plain = rows.filter(~F.coalesce(can_refer, F.lit(False)))
    both = hashed.unionByName(plain, allowMissingColumns=True)
    return both.select(
        "*", F.col("known.order_event").alias("order_event"), F.col("known.level").alias("order_level")
    ).drop("known")


def deltas(linked: DataFrame) -> DataFrame:
    """Nodes, edges and property updates each event brings (structural nodes are not counted)."""
    known = F.col("order_event").isNotNull()

    def pick(plain: list[int], extra: list[int]) -> Column:
        values = F.array(*[F.lit(v) for v in plain])
        more = F.array(*[F.lit(v) for v in extra])
        at = F.col("event_type") + 1
        inside = F.col("event_type").between(0, len(plain) - 1)
        return F.when(
            inside, F.get(values, at - 1) + F.when(known, F.get(more, at - 1)).otherwise(F.lit(0))
        ).otherwise(F.lit(0))

    # order: New, Modify, Cancel, Trade, Snapshot, SessionMarker, VenueStatus
    none = [0, 0, 0, 0, 0, 0, 0]
    return linked.select(
        "event_id",
        "event_type",
        pick([2, 1, 1, 2, 1, 2, 0], none).alias("nodes_added"),
        pick([4, 0, 0, 3, 1, 2, 0], [0, 1, 1, 1, 0, 0, 0]).alias("edges_added"),
        pick([2, 0, 0, 0, 1, 0, 1], [0, 3, 4, 4, 0, 0, 0]).alias("properties_updated"),
    )


# --- levels -----------------------------------------------------------------------------------------


def level_changes(linked: DataFrame) -> DataFrame:
    """One row per event that touches a price level: a signed change or a snapshot value, and the
    samples for the refill and depletion averages."""
    known = F.col("order_event").isNotNull()
    own = _is("NewOrder", "BookSnapshot")
    level = F.when(own, F.col("level")).when(known & _is("ModifyOrder", "CancelOrder", "Trade"), F.col("order_level"))
    change = (
        F.when(_is("NewOrder"), F.col("qty_fp"))
        .when(_is("ModifyOrder"), F.col("qty_fp") - F.col("order_depth"))
        .when(_is("CancelOrder"), -F.col("order_depth"))
        .when(_is("Trade"), -F.col("qty_fp"))
    )
    spent = F.when(_is("CancelOrder"), F.col("order_depth")).when(_is("Trade"), F.col("qty_fp"))
    return linked.select(
        level.alias("level_id"),
        *ORDER,
        "event_id",
        change.alias("change"),
        F.when(_is("BookSnapshot"), F.col("qty_fp")).alias("snapshot"),
        F.when(_is("NewOrder"), F.col("qty_fp")).alias("refill"),
        spent.alias("spent"),
    ).filter(F.col("level_id").isNotNull())


def level_history(changes: DataFrame) -> DataFrame:
    """Depth and queue length of the level after every change. Depth is a sum reflected at 0 inside
    the island that follows each snapshot (the snapshot is its first step)."""
    islands = running(changes, ["level_id"], ORDER, _island=count_of(F.col("snapshot").isNotNull()))
    step = F.coalesce("snapshot", "change")
    depth = reflected_sum(islands, ["level_id", "_island"], ORDER, step, "depth")
    sign = F.coalesce(F.signum("change").cast("bigint"), F.lit(0).cast("bigint"))
    queue = reflected_sum(depth, ["level_id"], ORDER, sign, "queue_length")
    return queue.drop("_island", "_chunk")


def ema_rates(changes: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Final refill and depletion averages per level: a sample followed by j later ones weighs
    alpha * (1-alpha)^j, so the average is a plain sum; j is a running count from the newest back."""
    back = changes.select(
        "level_id", (-F.col("ts_exchange_ns")).alias("_t"), (-F.col("seq")).alias("_q"), "refill", "spent"
    )
    ranked = running(
        back, ["level_id"], ["_t", "_q"],
        _r=count_of(F.col("refill").isNotNull()), _s=count_of(F.col("spent").isNotNull()),
    )

    def mean(value: str, rank: str) -> Column:
        return F.coalesce(F.sum(alpha * F.pow(F.lit(1 - alpha), F.col(rank) - 1) * F.col(value)), F.lit(0.0))

    return ranked.groupBy("level_id").agg(
        mean("refill", "_r").alias("refill_rate"), mean("spent", "_s").alias("depletion_rate")
    )


def level_state(changes: DataFrame) -> DataFrame:
    """Final depth, queue length and update time per level, with its parsed key."""
    latest = level_history(changes).groupBy("level_id").agg(
        F.max_by(F.struct("depth", "queue_length"), F.struct(*ORDER)).alias("last"),
        F.min("ts_exchange_ns").alias("created_at_ns"),
        F.max("ts_exchange_ns").alias("updated_at_ns"),
    )
    part = lambda i: F.split_part("level_id", F.lit(":"), F.lit(i))
    return latest.select(
        "level_id", "last.depth", "last.queue_length", "created_at_ns", "updated_at_ns",
        part(2).cast("int").alias("symbol_id"), part(3).cast("int").alias("venue_id"),
        part(4).cast("bigint").alias("price_fp"), part(5).cast("int").alias("side"),
    )


def order_state(linked: DataFrame) -> DataFrame:
    """Final depth, modify count and cancel / fill flags per order node."""
    qty, before = F.col("qty_fp"), F.col("order_depth")
    after = (
        F.when(_is("NewOrder", "ModifyOrder"), qty)
        .when(_is("CancelOrder"), F.lit(0).cast("bigint"))
        .otherwise(F.greatest(F.lit(0).cast("bigint"), before - qty))
    )
    # an event can open an order and, for the order before it, is nothing: New belongs to itself
    target = F.when(_is("NewOrder"), F.col("event_id")).otherwise(F.col("order_event"))
    rows = linked.filter(_is("NewOrder") | F.col("order_event").isNotNull()).withColumns(
        {"_target": target, "_after": after}
    )
    return rows.groupBy(F.col("_target").alias("order_event")).agg(
        F.max_by("_after", F.struct(*ORDER)).alias("depth"),
        F.count_if(_is("ModifyOrder")).alias("modify_count"),
        F.max(_is("CancelOrder").cast("int")).alias("cancel_hazard"),
        F.max(_is("Trade").cast("int")).alias("fill_hazard"),
        F.min("ts_exchange_ns").alias("created_at_ns"),
        F.max("ts_exchange_ns").alias("updated_at_ns"),
    )


# --- nodes and edges ------------------------------------------------------------------------------------


def _props(**values: Column) -> Column:
    parts = [x for name, v in values.items() for x in (F.lit(PROP[name]), v.cast("double"))]
    return F.create_map(*parts) if parts else F.create_map().cast("map<int,double>")


def _node(kind: str, node_id: Column, props: Column, created: Column, updated: Column) -> list[Column]:
    return [
        node_id.alias("id"),
        F.lit(NODE[kind]).alias("kind"),
        props.cast("map<int,double>").alias("properties"),
        created.alias("created_at_ns"),
        updated.alias("updated_at_ns"),
    ]


def structural_nodes(events: DataFrame) -> DataFrame:
    """One Symbol and one Venue node per key, created at first sight; a venue carries its last
    status."""
    ts = F.col("ts_exchange_ns")
    symbols = (
        events.filter(_is("NewOrder", "Trade", "BookSnapshot", "SessionMarker"))
        .groupBy("symbol_id")
        .agg(F.min(ts).alias("t"))
    )
    venues = (
        events.filter(_is("NewOrder", "Trade", "BookSnapshot", "VenueStatus"))
        .groupBy("venue_id")
        .agg(
            F.min(ts).alias("t"),
            F.max_by("flags", F.when(_is("VenueStatus"), F.struct(*ORDER))).alias("flags"),
            F.max(F.when(_is("VenueStatus"), ts)).alias("status_at"),
        )
    )
    status = F.when(
        F.col("status_at").isNotNull(), _props(InfluenceScore=F.col("flags"))
    ).otherwise(F.create_map().cast("map<int,double>"))
    return symbols.select(
        *_node("Symbol", symbol_key(F.col("symbol_id")), _props(InfluenceScore=F.col("symbol_id")), F.col("t"), F.col("t"))
    ).unionByName(
        venues.select(*_node("Venue", venue_key(F.col("venue_id")), status, F.col("t"), F.coalesce("status_at", "t")))
    )


def venue_status(events: DataFrame) -> DataFrame:
    """Last status flags per venue."""
    return (
        events.filter(_is("VenueStatus"))
        .groupBy("venue_id")
        .agg(F.max_by("flags", F.struct(*ORDER)).alias("flags"), F.max("ts_exchange_ns").alias("updated_at_ns"))
    )


def level_nodes(changes: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    state = level_state(changes).join(ema_rates(changes), "level_id")
    props = _props(
        VisibleDepth=F.col("depth"), QueueLength=F.col("queue_length"), LocalImbalance=zero, SpreadDistance=zero,
        RefillRate=F.col("refill_rate"), DepletionRate=F.col("depletion_rate"),
    )
    return state.select(*_node("PriceLevel", F.col("level_id"), props, F.col("created_at_ns"), F.col("updated_at_ns")))


def order_nodes(linked: DataFrame) -> DataFrame:
    props = _props(
        VisibleDepth=F.col("depth"), Age=F.lit(0), ModifyCount=F.col("modify_count"),
        CancelHazard=F.col("cancel_hazard"), FillHazard=F.col("fill_hazard"),
    )
    return order_state(linked).select(
        *_node("Order", F.concat(F.lit("ord:"), "order_event"), props, F.col("created_at_ns"), F.col("updated_at_ns"))
    )


def event_nodes(events: DataFrame) -> DataFrame:
    """Nodes an event creates by itself: Event, Trade, TimeBucket and Regime, in one map-only pass."""
    ts = F.col("ts_exchange_ns")

    def made(when: Column, kind: str, prefix: str, props: Column) -> Column:
        node = F.struct(*_node(kind, F.concat(F.lit(prefix), "event_id"), props, ts, ts))
        return F.when(when, node)

    nodes = F.array(
        made(F.col("event_type") <= EVENT["BookSnapshot"], "Event", "ev:", _props(Age=F.lit(0))),
        made(_is("Trade"), "Trade", "trd:", _props(VisibleDepth=F.col("qty_fp"), PostTradeImpact=F.lit(0))),
        made(_is("SessionMarker"), "TimeBucket", "tb:", _props(Age=F.lit(0))),
        made(_is("SessionMarker"), "Regime", "rg:", _props(LocalRealizedVol=F.lit(0))),
    )
    return events.select(F.inline(F.filter(nodes, lambda n: n.isNotNull())))


def all_nodes(linked: DataFrame) -> DataFrame:
    return (
        structural_nodes(linked)
        .unionByName(level_nodes(level_changes(linked)))
        .unionByName(order_nodes(linked))
        .unionByName(event_nodes(linked))
    )


def all_edges(linked: DataFrame) -> DataFrame:
    """Edges of every event in one map-only pass."""
    event = F.concat(F.lit("ev:"), "event_id")
    order = F.concat(F.lit("ord:"), "event_id")
    trade = F.concat(F.lit("trd:"), "event_id")
    bucket = F.concat(F.lit("tb:"), "event_id")
    resting = F.concat(F.lit("ord:"), "order_event")
    symbol, venue = symbol_key(F.col("symbol_id")), venue_key(F.col("venue_id"))
    known = F.col("order_event").isNotNull()

    def edge(when: Column, kind: str, source: Column, target: Column) -> Column:
        made = F.struct(
            F.concat_ws(":", F.lit("e"), F.lit(EDGE[kind]), "event_id").alias("id"),
            F.lit(EDGE[kind]).alias("kind"),
            source.alias("source_id"),
            target.alias("target_id"),
            F.create_map().cast("map<string,double>").alias("properties"),
            F.col("ts_exchange_ns").alias("created_at_ns"),
        )
        return F.when(when, made)

    edges = F.array(
        edge(_is("NewOrder"), "AtLevel", order, F.col("level")),
        edge(_is("NewOrder"), "Generated", event, order),
        edge(_is("NewOrder"), "BelongsToSymbol", order, symbol),
        edge(_is("NewOrder"), "OnVenue", order, venue),
        edge(_is("ModifyOrder") & known, "ModifiedFrom", event, resting),
        edge(_is("CancelOrder") & known, "CanceledBy", resting, event),
        edge(_is("Trade"), "Generated", event, trade),
        edge(_is("Trade"), "BelongsToSymbol", trade, symbol),
        edge(_is("Trade"), "OnVenue", trade, venue),
        edge(_is("Trade") & known, "Matched", trade, resting),
        edge(_is("BookSnapshot"), "Generated", event, F.col("level")),
        edge(_is("SessionMarker"), "InRegime", bucket, F.concat(F.lit("rg:"), "event_id")),
        edge(_is("SessionMarker"), "BelongsToSymbol", bucket, symbol),
    )
    return linked.select(F.inline(F.filter(edges, lambda e: e.isNotNull())))


def rows_of_type(linked: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(event-made nodes, edges) of one event type."""
    rows = linked.filter(_is(name))
    return event_nodes(rows), all_edges(rows)


# --- level books --------------------------------------------------------------------------------------------


def price_ladder(levels: DataFrame) -> DataFrame:
    """Non-empty levels in book order: asks upwards, bids downwards."""
    rank = F.when(F.col("side") == 1, F.col("price_fp")).otherwise(-F.col("price_fp"))
    return levels.filter("depth > 0").withColumn("book_rank", rank)


def next_tick_chain(levels: DataFrame) -> DataFrame:
    """Links between neighbouring non-empty levels of a book side."""
    book = ["symbol_id", "venue_id", "side"]
    rows = running(price_ladder(levels), book, ["book_rank", "level_id"], prev=last_of(F.col("level_id")))
    return rows.filter(F.col("prev").isNotNull()).select(
        *book, F.col("prev").alias("source_id"), F.col("level_id").alias("target_id")
    )


def local_imbalance(levels: DataFrame) -> DataFrame:
    bid = F.sum(F.when(F.col("side") == 0, F.col("depth")).otherwise(F.lit(0)))
    ask = F.sum(F.when(F.col("side") == 1, F.col("depth")).otherwise(F.lit(0)))
    return levels.groupBy("symbol_id", "venue_id").agg(
        F.when(bid + ask > 0, (bid - ask).cast("double") / (bid + ask).cast("double")).otherwise(F.lit(0.0)).alias("imbalance")
    )


def spread_distance(levels: DataFrame, tick: int) -> DataFrame:
    """Distance of every non-empty level from its book's mid, in ticks."""
    live = levels.filter("depth > 0")
    best = live.groupBy("symbol_id", "venue_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("price_fp"))).alias("bid"),
        F.min(F.when(F.col("side") == 1, F.col("price_fp"))).alias("ask"),
    )
    mid = (F.col("bid") + F.col("ask")) / 2.0
    return live.join(best, ["symbol_id", "venue_id"]).select(
        "level_id", (F.abs(F.col("price_fp") - mid) / float(tick)).alias("ticks")
    ).filter(F.col("ticks").isNotNull())
