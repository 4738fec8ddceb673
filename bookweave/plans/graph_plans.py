"""Graph queries over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bookweave.operators import graph as G
from bookweave.operators import graph_queries as GQ
from bookweave.operators.topk import newest_per_key  # noqa: F401
from bookweave.plans.catalog import query
from bookweave.schemas import EDGE, PROP
from bookweave.session import cut_lineage
from bookweave.sources.driver_tables import GRAPH_SQL, graph_events

GR = f"WITH {GRAPH_SQL} "
EDGE_COLS = ["id", "kind", "source_id", "target_id", "created_at_ns"]


def linked(spark, d):
    return G.with_orders(graph_events(spark, d))


def graph(spark, d):
    """Node and edge tables; the linked events feed both, so they are written once."""
    rows = cut_lineage(linked(spark, d))
    return G.all_nodes(rows), G.all_edges(rows)


def stored_graph(spark, d):
    """The same tables written out, for questions that read them several times."""
    nodes, edges = graph(spark, d)
    return cut_lineage(nodes), cut_lineage(edges)


@query("order_of_event", "C2 C3", GR + "SELECT seq, order_event, order_level, order_depth FROM lk WHERE event_type IN (1, 2, 3)")
def _(spark, d):
    return linked(spark, d).filter("event_type IN (1, 2, 3)").select("seq", "order_event", "order_level", "order_depth")


DELTA = """SELECT event_id, event_type, CASE event_type WHEN 0 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 0 ELSE 1 END AS nodes_added,
 CASE event_type WHEN 0 THEN 4 WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN 3 + k WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS edges_added,
 CASE event_type WHEN 0 THEN 2 WHEN 1 THEN 3 * k WHEN 2 THEN 4 * k WHEN 3 THEN 4 * k WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS properties_updated
 FROM (SELECT *, CASE WHEN order_event IS NULL THEN 0 ELSE 1 END AS k FROM lk)"""


@query("graph_deltas", "I1 I2", GR + DELTA)
def _(spark, d):
    return G.deltas(linked(spark, d))


@query(
    "graph_delta_totals",
    "D27",
    GR + f"SELECT event_type, sum(nodes_added)::BIGINT AS nodes_added, sum(edges_added)::BIGINT AS edges_added, sum(properties_updated)::BIGINT AS properties_updated FROM ({DELTA}) GROUP BY 1",
)
def _(spark, d):
    rows = G.deltas(linked(spark, d))
    return rows.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("nodes_added", "edges_added", "properties_updated")])


@query("structural_nodes", "I3", GR + "SELECT id, kind, created_at_ns, updated_at_ns FROM nodes WHERE kind IN (0, 1)")
def _(spark, d):
    return G.structural_nodes(graph_events(spark, d)).select("id", "kind", "created_at_ns", "updated_at_ns")


@query("venue_status", "I10", GR + "SELECT venue_id, flags, updated_at_ns FROM vs")
def _(spark, d):
    return G.venue_status(graph_events(spark, d))


def _add_rows(name, ids, kind, code):
    sql = GR + f"SELECT id, kind, source_id, target_id, created_at_ns FROM edges WHERE event_type = {code} UNION ALL SELECT n.id, 100 + n.kind, NULL, NULL, n.created_at_ns FROM nodes n JOIN lk ON split_part(n.id, ':', 2) = lk.event_id WHERE lk.event_type = {code} AND n.kind IN (4, 5, 7, 8)"

    @query(name, ids, sql)
    def _(spark, d):
        nodes, edges = G.rows_of_type(linked(spark, d), kind)
        none = F.lit(None).cast("string")
        shaped = nodes.select("id", (F.col("kind") + 100).alias("kind"), none.alias("source_id"), none.alias("target_id"), "created_at_ns")
        return edges.select(*EDGE_COLS).unionByName(shaped)


for _name, _ids, _kind, _code in [
    ("new_order_rows", "I4", "NewOrder", 0),
    ("modify_order_rows", "I5", "ModifyOrder", 1),
    ("cancel_order_rows", "I6", "CancelOrder", 2),
    ("trade_rows", "I7", "Trade", 3),
    ("book_snapshot_rows", "I8", "BookSnapshot", 4),
    ("session_marker_rows", "I9", "SessionMarker", 5),
]:
    _add_rows(_name, _ids, _kind, _code)


@query("level_history", "E13 E14", GR + "SELECT level_id, seq, depth, queue_length FROM lh")
def _(spark, d):
    return G.level_history(G.level_changes(linked(spark, d))).select("level_id", "seq", "depth", "queue_length")


@query("level_rates", "E15", GR + "SELECT level_id, round(refill_rate, 2) AS refill_rate, round(depletion_rate, 2) AS depletion_rate FROM le")
def _(spark, d):
    rates = G.ema_rates(G.level_changes(linked(spark, d)))
    return rates.select("level_id", *[F.round(c, 2).alias(c) for c in ("refill_rate", "depletion_rate")])


@query("order_state", "E16", GR + "SELECT order_event, depth, modify_count, cancel_hazard, fill_hazard, created_at_ns, updated_at_ns FROM os")
def _(spark, d):
    return G.order_state(linked(spark, d))


@query("graph_nodes", "G3 I3", GR + "SELECT id, kind, created_at_ns, updated_at_ns, depth, cancel FROM nodes")
def _(spark, d):
    prop = lambda n: F.coalesce(F.try_element_at("properties", F.lit(PROP[n])), F.lit(0.0))
    return graph(spark, d)[0].select(
        "id", "kind", "created_at_ns", "updated_at_ns", prop("VisibleDepth").alias("depth"), prop("CancelHazard").alias("cancel")
    )


@query("graph_edges", "G3 I4", GR + "SELECT id, kind, source_id, target_id, created_at_ns FROM edges")
def _(spark, d):
    return graph(spark, d)[1].select(*EDGE_COLS)


@query("node_counts", "D28", GR + "SELECT kind, count(*) AS n FROM nodes GROUP BY 1")
def _(spark, d):
    return GQ.node_counts(graph(spark, d)[0])


@query("node_lookup", "I11", GR + "SELECT id, kind, created_at_ns FROM nodes WHERE id = 'sym:3' OR kind = 1")
def _(spark, d):
    nodes = graph(spark, d)[0]
    return GQ.node_by_key(nodes, "sym:3").unionByName(GQ.nodes_by_kind(nodes, "Venue")).select("id", "kind", "created_at_ns")


@query(
    "node_degrees",
    "D29",
    GR + "SELECT id, sum(o)::BIGINT AS out_edges, sum(i)::BIGINT AS in_edges FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) GROUP BY 1",
)
def _(spark, d):
    return GQ.degrees(graph(spark, d)[1])


@query(
    "node_degrees_by_kind",
    "D29",
    GR + "SELECT id, kind, sum(o)::BIGINT AS out_edges, sum(i)::BIGINT AS in_edges FROM (SELECT source_id AS id, kind, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, kind, 0, 1 FROM edges) GROUP BY 1, 2",
)
def _(spark, d):
    return GQ.degrees(graph(spark, d)[1], by_kind=True)


END = 1_705_708_800_000_000_000  # 2024-01-20
DAY5 = 432_000_000_000_000


@query(
    "state_window",
    "D30",
    GR
    + f""", fr AS (SELECT id FROM nodes WHERE created_at_ns BETWEEN {END - DAY5} AND {END})
 SELECT 'nodes' AS what, count(*) AS n FROM fr UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (SELECT id FROM fr) OR target_id IN (SELECT id FROM fr)""",
)
def _(spark, d):
    return GQ.state_window(*stored_graph(spark, d), END, DAY5)


MEMBERS = """, mb AS (SELECT DISTINCT target_id AS symbol, source_id AS id FROM edges WHERE kind = 6 UNION SELECT id, id FROM nodes WHERE kind = 0),
 ind AS (SELECT s.symbol, e.* FROM edges e JOIN mb s ON e.source_id = s.id JOIN mb t ON e.target_id = t.id AND s.symbol = t.symbol) """


@query("symbol_subgraph", "I14", GR + MEMBERS + "SELECT symbol, id, 'node' AS what FROM mb UNION ALL SELECT symbol, id, 'edge' FROM ind")
def _(spark, d):
    nodes, edges = stored_graph(spark, d)
    members = GQ.symbol_members(nodes, edges)
    parts = GQ.induced_edges(edges, members).select("symbol", "id", F.lit("edge").alias("what"))
    return members.select("symbol", "id", F.lit("node").alias("what")).unionByName(parts)


@query(
    "connectivity_score",
    "D31",
    GR + MEMBERS + "SELECT m.symbol, round(coalesce(e.n, 0) / m.n::DOUBLE, 9) AS score FROM (SELECT symbol, count(*) AS n FROM mb GROUP BY 1) m LEFT JOIN (SELECT symbol, count(*) AS n FROM ind GROUP BY 1) e USING (symbol)",
)
def _(spark, d):
    nodes, edges = stored_graph(spark, d)
    return GQ.connectivity(edges, GQ.symbol_members(nodes, edges)).select("symbol", F.round("score", 9).alias("score"))


@query("price_ladder", "F7", GR + "SELECT level_id, row_number() OVER (PARTITION BY symbol_id, venue_id, side ORDER BY CASE WHEN side = 1 THEN price_fp ELSE -price_fp END) AS rn FROM ls WHERE depth > 0")
def _(spark, d):
    from bookweave.operators.ordered import row_numbers

    rows = G.price_ladder(G.level_state(G.level_changes(linked(spark, d))))
    return row_numbers(rows, ["symbol_id", "venue_id", "side"], ["book_rank", "level_id"]).select("level_id", "rn")


@query(
    "next_tick_chain",
    "E18",
    GR
    + """SELECT symbol_id, venue_id, side, p AS source_id, level_id AS target_id FROM (SELECT *, lag(level_id) OVER (PARTITION BY symbol_id, venue_id, side ORDER BY CASE WHEN side = 1 THEN price_fp ELSE -price_fp END) AS p FROM ls WHERE depth > 0) WHERE p IS NOT NULL""",
)
def _(spark, d):
    return G.next_tick_chain(G.level_state(G.level_changes(linked(spark, d))))


@query(
    "local_imbalance",
    "E32",
    GR
    + """SELECT symbol_id, venue_id, round(CASE WHEN b + a > 0 THEN (b - a)::DOUBLE / (b + a)::DOUBLE ELSE 0 END, 9) AS imbalance FROM (SELECT symbol_id, venue_id, coalesce(sum(depth) FILTER (side = 0), 0) AS b, coalesce(sum(depth) FILTER (side = 1), 0) AS a FROM ls GROUP BY 1, 2)""",
)
def _(spark, d):
    rows = G.local_imbalance(G.level_state(G.level_changes(linked(spark, d))))
    return rows.select("symbol_id", "venue_id", F.round("imbalance", 9).alias("imbalance"))


@query(
    "spread_distance",
    "E33",
    GR
    + """, b AS (SELECT symbol_id, venue_id, max(price_fp) FILTER (side = 0) AS bid, min(price_fp) FILTER (side = 1) AS ask FROM ls WHERE depth > 0 GROUP BY 1, 2)
 SELECT level_id, abs(price_fp - (bid + ask) / 2.0::DOUBLE) / 1000000.0::DOUBLE AS ticks FROM ls JOIN b USING (symbol_id, venue_id) WHERE depth > 0 AND bid IS NOT NULL AND ask IS NOT NULL""",
)
def _(spark, d):
    return G.spread_distance(G.level_state(G.level_changes(linked(spark, d))), 1_000_000)


@query(
    "recent_symbol_events",
    "F6",
    GR
    + """SELECT * FROM (SELECT b.target_id AS symbol, g.source_id AS event, n.created_at_ns, row_number() OVER (PARTITION BY b.target_id ORDER BY n.created_at_ns DESC, g.source_id DESC) AS rank
 FROM edges g JOIN edges b ON g.kind = 2 AND b.kind = 6 AND g.target_id = b.source_id JOIN nodes n ON n.id = g.source_id) WHERE rank <= 20""",
)
def _(spark, d):
    nodes, edges = graph(spark, d)
    return GQ.recent_events(edges, nodes, 20)


SEEDS = ", sd AS (SELECT arg_min(source_id, created_at_ns) AS id FROM edges WHERE kind = 6 AND source_id LIKE 'tb:%' GROUP BY target_id), ad AS (SELECT id AS edge_id, source_id AS a, target_id AS b FROM edges UNION ALL SELECT id, target_id, source_id FROM edges) "
BFS = (
    SEEDS
    + """, h1 AS (SELECT DISTINCT sd.id AS seed, b AS id FROM sd JOIN ad ON a = sd.id WHERE b <> sd.id),
 h2 AS (SELECT DISTINCT seed, b AS id FROM h1 JOIN ad ON a = h1.id WHERE b <> seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = b)),
 nb AS (SELECT id AS seed, id, 0 AS hop FROM sd UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2),
 ne AS (SELECT DISTINCT seed, edge_id FROM (SELECT seed, id FROM nb WHERE hop < 2) f JOIN ad ON a = f.id) """
)


def seeds(edges):
    """The first time bucket of every symbol."""
    first = edges.filter((F.col("kind") == EDGE["BelongsToSymbol"]) & F.col("source_id").startswith("tb:"))
    return first.groupBy("target_id").agg(F.min_by("source_id", "created_at_ns").alias("id")).select("id")


def hood(spark, d):
    nodes, edges = stored_graph(spark, d)
    return (nodes, edges, *GQ.neighborhoods(edges, seeds(edges), 2))


@query("neighborhood_nodes", "I12 G4", GR + BFS + "SELECT seed, id, hop FROM nb")
def _(spark, d):
    return hood(spark, d)[2]


@query("neighborhood_edges", "I12", GR + BFS + "SELECT seed, edge_id FROM ne")
def _(spark, d):
    return hood(spark, d)[3]


COO = """, ix AS (SELECT seed, nb.id, kind, row_number() OVER (PARTITION BY seed ORDER BY hop, created_at_ns, nb.id) - 1 AS node_index FROM nb JOIN nodes ON nodes.id = nb.id) """


@query(
    "coo_edges",
    "I13",
    GR + BFS + COO + "SELECT ne.seed, ne.edge_id, s.node_index AS src, t.node_index AS dst, e.kind AS edge_kind FROM ne JOIN edges e ON e.id = ne.edge_id JOIN ix s ON s.seed = ne.seed AND s.id = e.source_id JOIN ix t ON t.seed = ne.seed AND t.id = e.target_id",
)
def _(spark, d):
    nodes, edges, members, met = hood(spark, d)
    return GQ.coo_packing(nodes, edges, members, met)[1]


NOW, KEEP = END, DAY5
EXP = f""", ex AS (SELECT id, kind, created_at_ns FROM nodes WHERE (kind IN (4, 5, 7) AND created_at_ns < {NOW - KEEP}) OR (kind = 3 AND updated_at_ns < {NOW - KEEP} AND (depth = 0 OR cancel >= 1))
  OR (kind = 2 AND updated_at_ns < {NOW - KEEP} AND depth = 0)) """


@query("expired_nodes", "I15", GR + EXP + "SELECT id, kind FROM ex")
def _(spark, d):
    return GQ.expired(graph(spark, d)[0], NOW, KEEP).select("id", "kind")


@query(
    "compaction_counts",
    "I15 K10",
    GR + EXP + "SELECT 'nodes' AS what, count(*) AS n FROM ex UNION ALL SELECT 'edges', count(*) FROM edges WHERE source_id IN (SELECT id FROM ex) OR target_id IN (SELECT id FROM ex)",
)
def _(spark, d):
    nodes, edges = stored_graph(spark, d)
    return GQ.removal_counts(edges, GQ.expired(nodes, NOW, KEEP))


@query("surviving_edges", "C14", GR + EXP + "SELECT id FROM edges WHERE source_id NOT IN (SELECT id FROM ex) AND target_id NOT IN (SELECT id FROM ex)")
def _(spark, d):
    nodes, edges = stored_graph(spark, d)
    return GQ.cascade(edges, GQ.expired(nodes, NOW, KEEP)).select("id")


@query(
    "emergency_removals",
    "I16",
    GR
    + """SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at_ns, id) AS rn FROM nodes WHERE kind NOT IN (0, 1, 8, 9)) WHERE rn <= (SELECT CASE WHEN count(*) > 5000 THEN count(*) - 4000 ELSE 0 END FROM nodes)""",
)
def _(spark, d):
    return GQ.emergency_removals(stored_graph(spark, d)[0], 5000).select("id")


@query(
    "order_lineage",
    "I17",
    GR + "SELECT target_id AS order_node, source_id AS event, created_at_ns, row_number() OVER (PARTITION BY target_id ORDER BY created_at_ns, source_id) AS step FROM edges WHERE kind = 4",
)
def _(spark, d):
    return GQ.order_lineage(graph(spark, d)[1]).withColumnRenamed("rn", "step")


@query(
    "regime_path",
    "I18",
    GR
    + f"""SELECT b.target_id AS symbol, r.source_id AS bucket, r.target_id AS regime, r.created_at_ns, row_number() OVER (PARTITION BY b.target_id ORDER BY r.created_at_ns, r.target_id) AS step
 FROM edges r JOIN edges b ON r.kind = 10 AND b.kind = 6 AND r.source_id = b.source_id WHERE r.created_at_ns BETWEEN {END - DAY5} AND {END}""",
)
def _(spark, d):
    return GQ.regime_path(graph(spark, d)[1], END - DAY5, END)


@query("strategy_states", "I19", GR + "SELECT 'trd:' || event_id AS id, 'st:' || symbol_id AS state FROM lk WHERE event_type = 3")
def _(spark, d):
    """Trades affect the strategy state of their symbol (no handler makes these edges, so the query does)."""
    trades = graph_events(spark, d).filter("event_type = 3")
    edges = trades.select(F.concat(F.lit("trd:"), "event_id").alias("source_id"), F.concat(F.lit("st:"), "symbol_id").alias("target_id"), F.lit(EDGE["AffectsState"]).alias("kind"))
    nodes = edges.select(F.col("target_id").alias("id"), F.lit(9).alias("kind")).distinct()
    return GQ.strategy_states(nodes, edges)
