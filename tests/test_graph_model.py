import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookweave.operators import graph as G
from bookweave.operators import graph_queries as GQ
from bookweave.operators import model as M
from bookweave.operators import registry as R
from bookweave.functions import features as FE
from bookweave.functions import losses as LO


def test_handlers_on_one_order(spark):
    cols = "event_id string, ts_exchange_ns long, seq long, venue_id int, symbol_id int, event_type int, side int, price_fp long, qty_fp long, order_id_hash string, flags int"
    rows = [("a", 1, 1, 1, 1, 0, 0, 100, 50, "h", 0), ("b", 2, 2, 1, 1, 1, 0, 100, 30, "h", 0), ("c", 3, 3, 1, 1, 3, 0, 100, 10, "h", 0),
            ("d", 4, 4, 1, 1, 2, 0, 100, 0, "h", 0), ("e", 5, 5, 1, 1, 1, 0, 100, 7, "zz", 0), ("f", 6, 6, 1, 1, 4, 0, 100, 99, None, 0)]
    linked = G.with_orders(spark.createDataFrame(rows, cols))
    got = {r.event_id: (r.nodes_added, r.edges_added, r.properties_updated) for r in G.deltas(linked).collect()}
    assert got == {"a": (2, 4, 2), "b": (1, 1, 3), "c": (2, 4, 4), "d": (1, 1, 4), "e": (1, 0, 0), "f": (1, 1, 1)}
    depth = {r.event_id: r.order_depth for r in linked.collect()}
    assert (depth["b"], depth["c"], depth["d"], depth["e"]) == (50, 30, 20, None)
    history = {r.event_id: (r.depth, r.queue_length) for r in G.level_history(G.level_changes(linked)).collect()}
    assert history == {"a": (50, 1), "b": (30, 0), "c": (20, 0), "d": (0, 0), "f": (99, 0)}
    rates = G.ema_rates(G.level_changes(linked)).first()
    assert rates.refill_rate == pytest.approx(5.0)
    assert rates.depletion_rate == pytest.approx(0.1 * 20 + 0.9 * 0.1 * 10)
    state = G.order_state(linked).first()
    assert (state.depth, state.modify_count, state.cancel_hazard, state.fill_hazard) == (0, 1, 1, 1)


def test_neighborhoods_against_bfs(spark):
    rng = random.Random(2)
    pairs = [(f"e{i}", f"n{rng.randrange(60)}", f"n{0 if rng.random() < .3 else rng.randrange(60)}") for i in range(90)]
    edges = spark.createDataFrame(pairs, "id string, source_id string, target_id string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n3",)], "id string")
    nodes, met = GQ.neighborhoods(edges, seeds, 2)
    want_nodes, want_edges = set(), set()
    for s in ("n1", "n2", "n3"):
        dist, frontier = {s: 0}, [s]
        for hop in (1, 2):
            new = []
            for f in frontier:
                for e, a, b in pairs:
                    if f in (a, b):
                        want_edges.add((s, e))
                        other = b if f == a else a
                        if other not in dist:
                            dist[other] = hop
                            new.append(other)
            frontier = new
        want_nodes |= {(s, n, h) for n, h in dist.items()}
    assert {(r.seed, r.id, r.hop) for r in nodes.collect()} == want_nodes
    assert {(r.seed, r.edge_id) for r in met.collect()} == want_edges


def layer(rng, o, i):
    return rng.normal(size=(o, i)), rng.normal(size=o)


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 6))
    edges = [(int(a), int(b), int(t)) for a, b, t in zip(rng.integers(0, 30, 80), np.where(rng.random(80) < .4, 3, rng.integers(0, 30, 80)), rng.integers(0, 14, 80))]
    nodes = spark.createDataFrame([(i, i % 4 if i else 9, i % 10, x[i].tolist()) for i in range(30)], "id long, g int, kind int, h array<double>")
    return rng, x, edges, nodes, spark.createDataFrame(edges, "src long, dst long, edge_type int")


def test_message_passing(graph):
    rng, x, edges, nodes, e = graph
    own, types = layer(rng, 5, 6), [layer(rng, 5, 6) for _ in range(12)]
    want = x @ own[0].T + own[1]
    for i in range(30):
        msgs = [types[t % 12][0] @ x[a] + types[t % 12][1] for a, b, t in edges if b == i]
        if msgs:
            want[i] += np.mean(msgs, axis=0)
    want = np.maximum(want, 0)
    for r in M.message_passing(nodes, e, own, types).collect():
        np.testing.assert_allclose(r.h, want[r.id], atol=1e-9)


def test_attention_pool(graph, spark):
    rng, x, _, nodes, _ = graph
    heads = [{n: layer(rng, 3, 6) for n in "qkv"} for _ in range(2)]
    out = layer(rng, 4, 6)
    groups = spark.createDataFrame([(g,) for g in (0, 1, 2, 3, 9, 77)], "g int")
    pooled, weights = M.attention_pool(nodes, "g", ["id"], heads, out, groups=groups)
    by_group = {}
    for i in range(30):
        by_group.setdefault(i % 4 if i else 9, []).append(i)
    got = {r.g: r.pooled for r in pooled.collect()}
    share = {r.id: r.weight for r in weights.collect()}
    np.testing.assert_allclose(got[77], np.zeros(4))
    for g, ids in by_group.items():
        parts, mean = [], np.zeros(len(ids))
        for h in heads:
            q = h["q"][0] @ x[ids[-1]] + h["q"][1]
            s = np.array([q @ (h["k"][0] @ x[i] + h["k"][1]) for i in ids]) / np.sqrt(3)
            a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            mean += a / 2
            parts.append(sum(w * (h["v"][0] @ x[i] + h["v"][1]) for w, i in zip(a, ids)))
        np.testing.assert_allclose(got[g], out[0] @ np.concatenate(parts) + out[1], atol=1e-9)
        np.testing.assert_allclose([share[i] for i in ids], mean, atol=1e-9)


def test_family_pools(graph):
    _, x, _, nodes, _ = graph
    for r in M.family_pools(nodes, "g", ["id"]).collect():
        ids = [i for i in range(30) if (i % 4 if i else 9) == r.g]
        of = lambda *k: [i for i in ids if i % 10 in k]
        book = of(0, 2)
        if book:
            n = np.linalg.norm(x[book], axis=1)
            w = np.exp(n - n.max())
            np.testing.assert_allclose(r.book_state, (w[:, None] * x[book]).sum(0) / w.sum(), atol=1e-9)
        else:
            assert r.book_state is None
        ev = of(4, 5)
        if ev:
            w = 0.9 ** np.arange(len(ev) - 1, -1, -1)
            np.testing.assert_allclose(r.event_stream, (w[:, None] * x[ev]).sum(0) / w.sum(), atol=1e-9)
        if of(3):
            np.testing.assert_allclose(r.queue_state, x[of(3)].sum(0), atol=1e-9)
        if of(7, 8, 9):
            np.testing.assert_allclose(r.risk_context, x[of(7, 8, 9)].max(0), atol=1e-9)
        s, p = of(9), of(6)
        np.testing.assert_allclose(r.strategy_context, np.concatenate([x[s[0]] if s else np.zeros(6), x[p[0]] if p else np.zeros(6)]))


def test_compose_checks_widths(spark):
    none = F.lit(None).cast("array<double>")
    row = spark.range(1).select(*[(F.array_repeat(F.lit(1.0), w) if n == "queue_state" else none).alias(n) for n, w in M.FAMILIES])
    v = row.select(M.compose().alias("v")).first().v
    assert len(v) == 512 and sum(v) == 64 and v[128] == 1.0 and v[127] == 0.0
    bad = row.withColumn("book_state", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="book_state"):
        bad.select(M.compose()).collect()


def test_nearest_against_brute_force(graph, spark):
    _, x, _, nodes, _ = graph
    queries = spark.createDataFrame([("q", x[4].tolist())], "query_id string, q array<double>")
    got = [(r.id, r.rank) for r in M.nearest(nodes, queries, 5).orderBy("rank").collect()]
    d = 1 - x @ x[4] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[4])
    assert got == [(int(i), k + 1) for k, i in enumerate(np.argsort(d)[:5])]


def test_wrong_weight_size_fails(spark):
    df = spark.createDataFrame([("l", 0, 2, 2, [1.0], [0.0, 0.0])], "layer string, part int, out_dim int, in_dim int, w array<double>, b array<double>")
    with pytest.raises(Exception, match="bad weight size"):
        M.weight_table(df)


def test_losses(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [v(LO.huber(lit(a), lit(b))) for a, b in ((5.0, 5.0), (0.0, 0.5), (0.0, 5.0))] == [0, 0.125, 4.5]
    assert v(LO.binary_cross_entropy(lit(0.999), lit(1.0))) < 0.01 and v(LO.binary_cross_entropy(lit(0.01), lit(1.0))) > 2


def test_features(spark):
    df = spark.createDataFrame([({3: 1.0, 0: 2.0},)], "p map<int,double>")
    dense = df.select(FE.dense_node_features(F.col("p")).alias("f")).first().f
    assert len(dense) == 17 and (dense[0], dense[3], dense[7], dense[8]) == (2.0, 1.0, 0.01, 0.5)
    packed = df.select(FE.packed_features(F.lit(5), F.col("p"), 10.0).alias("f")).first().f
    assert packed == [0.5, 2.0, 1.0, 0, 0, 0, 0, 0]


def test_registry_errors(spark):
    reg = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "model_id long, name string, version int").withColumns(
        {"promoted_at": F.lit(None).cast("timestamp"), "retired_at": F.lit(None).cast("timestamp")})
    now = F.timestamp_seconds(F.lit(5))
    with pytest.raises(ValueError):
        R.promote(reg, 9, now)
    with pytest.raises(ValueError):
        R.register_models(reg, reg.limit(1))
    up = R.promote(R.promote(reg, 1, now), 2, now)
    assert [r.model_id for r in R.active_models(up).collect()] == [2]
    assert R.retire(up, 2, now).filter("retired_at is null").count() == 0
    with pytest.raises(ValueError):
        R.retire(R.retire(up, 2, now), 2, now)


def test_mlp_heads_and_stack(graph):
    rng, x, edges, nodes, e = graph
    a, b = layer(rng, 8, 6), layer(rng, 3, 8)
    sig = lambda z: 1 / (1 + np.exp(-z))
    hidden = np.maximum(x @ a[0].T + a[1], 0)
    for r in nodes.withColumn("y", M.mlp(F.col("h"), [a, b], "relu", "sigmoid")).collect():
        np.testing.assert_allclose(r.y, sig(hidden[r.id] @ b[0].T + b[1]), atol=1e-12)
    one, three, four = layer(rng, 1, 8), layer(rng, 3, 8), layer(rng, 4, 8)
    out = {"softmax3": three, "softmax4": four}
    mats = {n: [a, {1: one, 3: three, 4: four}[M.HEADS[n][1]]] for n in M.HEADS}
    z = (hidden @ one[0].T + one[1])[:, 0]
    soft = {}
    for n, w in ((3, three), (4, four)):
        s = hidden @ w[0].T + w[1]
        soft[n] = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    p, sp = sig(z), np.log1p(np.exp(z))
    want = {
        "mid_price": (z, abs(z) / (abs(z) + 1)), "slippage": (sp, 1 / (1 + sp)), "size": (p, 1 - 2 * abs(p - 0.5)),
        "regime_transition": (soft[3].argmax(1), np.maximum(0, (soft[3].max(1) - 1 / 3) / (2 / 3))),
        "venue": (soft[4].argmax(1), np.maximum(0, (soft[4].max(1) - 1 / 4) / (3 / 4))),
    }
    for n in ("fill_prob", "cancel_prob", "vol_jump", "place", "modify", "write_admission"):
        want[n] = (p, abs(2 * p - 1))
    got = M.score_heads(nodes, "h", mats, list(M.HEADS)).collect()
    assert len(got) == 30 * 11
    for r in got:
        np.testing.assert_allclose((r.value, r.confidence), [v[r.id] for v in want[r.head_name]], atol=1e-9)


def test_graph_embedding_is_the_composition(graph):
    rng, x, _, nodes, e = graph
    layers = [(layer(rng, 4, 6), [layer(rng, 4, 6)]), (layer(rng, 4, 4), [layer(rng, 4, 4)])]
    heads, out, project = [{n: layer(rng, 2, 4) for n in "qkv"} for _ in range(2)], layer(rng, 4, 4), layer(rng, 7, 4)
    step = M.message_passing(M.message_passing(nodes, e, *layers[0]), e, *layers[1])
    pooled = {r.g: r.pooled for r in M.attention_pool(step, "g", ["id"], heads, out)[0].collect()}
    got = M.graph_embedding(nodes, e, "g", ["id"], layers, heads, out, project).collect()
    assert len(got) == len(pooled)
    for r in got:
        np.testing.assert_allclose(r.embedding, np.maximum(project[0] @ pooled[r.g] + project[1], 0), atol=1e-9)
