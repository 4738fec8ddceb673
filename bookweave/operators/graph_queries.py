"""Questions to the node and edge tables: neighbourhoods, subgraphs, degrees, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.operators.ordered import row_numbers
from bookweave.schemas import EDGE, NODE, PROP
from bookweave.session import cut_lineage


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def nodes_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.col("kind") == NODE[kind])


def node_by_key(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.filter(F.col("id") == key)


def degrees(edges: DataFrame, by_kind: bool = False) -> DataFrame:
    """In and out edges per node: both ends as rows, counted with a map-side partial aggregate, so a
    hub costs one row per task."""
    ends = edges.select(
        "kind",
        F.inline(
            F.array(
                F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ),
    )
    keys = ["id", "kind"] if by_kind else ["id"]
    return ends.groupBy(*keys).agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with at least one end in ``ids``, each once."""
    keyed = ids.select(F.col("id").alias("_id")).distinct()
    by_source = edges.join(keyed, edges.source_id == F.col("_id"), "left_semi")
    by_target = edges.join(keyed, edges.target_id == F.col("_id"), "left_semi").join(
        keyed, edges.source_id == F.col("_id"), "left_anti"
    )
    return by_source.unionByName(by_target)


def cascade(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges that survive the removal of nodes."""
    gone = removed.select(F.col("id").alias("_id")).distinct()
    return edges.join(gone, edges.source_id == F.col("_id"), "left_anti").join(
        gone, edges.target_id == F.col("_id"), "left_anti"
    )


def state_window(nodes: DataFrame, edges: DataFrame, end_ns: int, duration_ns: int) -> DataFrame:
    """Nodes created in [end - duration, end] and edges that touch any of them."""
    fresh = nodes.filter(F.col("created_at_ns").between(end_ns - duration_ns, end_ns))
    n_nodes = fresh.select(F.lit("nodes").alias("what"))
    n_edges = touching(edges, fresh).select(F.lit("edges").alias("what"))
    return n_nodes.unionByName(n_edges).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def neighborhoods(edges: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhoods of many seeds at once: (seed, id, hop) and the edges met on the way,
    i.e. those at nodes of distance up to hops-1. One join per hop; each frontier is checkpointed."""
    both = F.array(
        F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")),
        F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")),
    )
    links = edges.select(F.col("id").alias("edge_id"), F.inline(both))
    frontier = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("hop", F.lit(0))
    seen, met = frontier, None
    for hop in range(1, hops + 1):
        step = frontier.select("seed", F.col("id").alias("a")).join(links, "a")
        found_edges = step.select("seed", "edge_id")
        met = found_edges if met is None else met.unionByName(found_edges)
        found = step.select("seed", F.col("b").alias("id")).distinct()
        frontier = cut_lineage(
            found.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        )
        seen = seen.unionByName(frontier)
    return seen, met.distinct()


def coo_packing(
    nodes: DataFrame, edges: DataFrame, members: DataFrame, member_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Dense node numbers per seed (by hop, creation, id) and edges as pairs of numbers."""
    placed = members.join(nodes.select("id", "kind", "properties", "created_at_ns"), "id")
    numbered = row_numbers(placed, ["seed"], ["hop", "created_at_ns", "id"], "rn")
    index = numbered.select("seed", "id", (F.col("rn") - 1).alias("node_index"), "kind", "properties")
    ends = member_edges.join(edges.select(F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"), "source_id", "target_id"), "edge_id")
    at = lambda name: index.select("seed", F.col("id").alias(name), F.col("node_index").alias(f"{name[:3]}_index"))
    pairs = ends.join(at("source_id"), ["seed", "source_id"]).join(at("target_id"), ["seed", "target_id"])
    return index, pairs.select("seed", "edge_id", F.col("sou_index").alias("src"), F.col("tar_index").alias("dst"), "edge_kind")


def symbol_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, id): the symbol node and all nodes that belong to it."""
    belongs = edges.filter(F.col("kind") == EDGE["BelongsToSymbol"]).select(
        F.col("target_id").alias("symbol"), F.col("source_id").alias("id")
    )
    own = nodes_by_kind(nodes, "Symbol").select(F.col("id").alias("symbol"), "id")
    return belongs.unionByName(own).distinct()


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in the same symbol's member set."""
    source = members.select("symbol", F.col("id").alias("source_id"))
    target = members.select("symbol", F.col("id").alias("target_id"))
    return edges.join(source, "source_id").join(target, ["symbol", "target_id"])


def connectivity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Induced edges per node of each symbol's subgraph."""
    n_nodes = members.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = induced_edges(edges, members).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_edges"))
    score = F.coalesce("n_edges", F.lit(0)) / F.col("n_nodes")
    return n_nodes.join(n_edges, "symbol", "left").select("symbol", score.alias("score"))


def recent_events(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Newest ``limit`` Event nodes per symbol that generated a node of the symbol. Each task first
    keeps its own newest rows per symbol (a window group limit), so a hot symbol stays small."""
    belongs = edges.filter(F.col("kind") == EDGE["BelongsToSymbol"]).select(
        F.col("source_id").alias("id"), F.col("target_id").alias("symbol")
    )
    made = edges.filter(F.col("kind") == EDGE["Generated"]).select(
        F.col("source_id").alias("event"), F.col("target_id").alias("id")
    )
    events = nodes_by_kind(nodes, "Event").select(F.col("id").alias("event"), "created_at_ns")
    rows = made.join(belongs, "id").join(events, "event").select("symbol", "event", "created_at_ns")
    from bookweave.operators.topk import newest_per_key

    return newest_per_key(rows, ["symbol"], [F.desc("created_at_ns"), F.desc("event")], limit)


def order_lineage(edges: DataFrame) -> DataFrame:
    """Modify events of every order, numbered in time order."""
    rows = edges.filter(F.col("kind") == EDGE["ModifiedFrom"]).select(
        F.col("target_id").alias("order_node"), F.col("source_id").alias("event"), "created_at_ns"
    )
    return row_numbers(rows, ["order_node"], ["created_at_ns", "event"], "step").drop("_chunk")


def regime_path(edges: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Regimes met by each symbol's time buckets in a window, numbered in order."""
    inside = edges.filter(F.col("created_at_ns").between(start_ns, end_ns))
    regime = inside.filter(F.col("kind") == EDGE["InRegime"]).select(
        F.col("source_id").alias("bucket"), F.col("target_id").alias("regime"), "created_at_ns"
    )
    symbol = inside.filter(F.col("kind") == EDGE["BelongsToSymbol"]).select(
        F.col("source_id").alias("bucket"), F.col("target_id").alias("symbol")
    )
    rows = regime.join(symbol, "bucket")
    return row_numbers(rows, ["symbol"], ["created_at_ns", "regime"], "step").drop("_chunk")


def strategy_states(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """StrategyState nodes reached through AffectsState edges."""
    affects = edges.filter(F.col("kind") == EDGE["AffectsState"]).select(
        F.col("source_id").alias("id"), F.col("target_id").alias("state")
    )
    states = nodes_by_kind(nodes, "StrategyState").select(F.col("id").alias("state"))
    return affects.join(states, "state")


def _prop(name: str) -> Column:
    return F.coalesce(F.try_element_at("properties", F.lit(PROP[name])), F.lit(0.0))


PROTECTED = ["Symbol", "Venue", "Regime", "StrategyState"]


def expired(nodes: DataFrame, now_ns: int, retention_ns: int = 60_000_000_000) -> DataFrame:
    """Nodes the sliding window lets go."""
    cutoff = F.lit(now_ns - retention_ns)
    kind = F.col("kind")
    old, idle = F.col("created_at_ns") < cutoff, F.col("updated_at_ns") < cutoff
    empty = _prop("VisibleDepth") == 0
    passing = kind.isin(NODE["Event"], NODE["Trade"], NODE["TimeBucket"]) & old
    ended = (kind == NODE["Order"]) & idle & (empty | (_prop("CancelHazard") >= 1))
    bare = (kind == NODE["PriceLevel"]) & idle & empty
    return nodes.filter(passing | ended | bare)


def removal_counts(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """How many nodes and edges a removal takes away."""
    lost = touching(edges, removed).select(F.lit("edges").alias("what"))
    return (
        removed.select(F.lit("nodes").alias("what"))
        .unionByName(lost)
        .groupBy("what")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def emergency_removals(nodes: DataFrame, cap: int) -> DataFrame:
    """Above the cap: the oldest unprotected nodes until at most 80 % of it are left."""
    total = nodes.select(F.count(F.lit(1))).scalar()
    excess = F.when(total > cap, total - F.lit(int(cap * 0.8))).otherwise(F.lit(0))
    free = nodes.filter(~F.col("kind").isin(*[NODE[k] for k in PROTECTED]))
    ranked = row_numbers(free, [], ["created_at_ns", "id"])
    return ranked.filter(F.col("rn") <= excess).drop("rn", "_chunk")
