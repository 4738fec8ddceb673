"""Heads, embeddings and statistics on odd inputs; training against its closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookweave.operators import model as M
from bookweave.operators import training as T


def test_group_without_nodes_has_a_zero_embedding(spark):
    rng = np.random.default_rng(1)
    layer = lambda o, n: (rng.normal(size=(o, n)), rng.normal(size=o))
    heads = [{n: layer(2, 4) for n in "qkv"} for _ in range(2)]
    nodes = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0]), (2, "a", [0.0, 1.0, 0.0])], "id bigint, seed string, h array<double>")
    edges = spark.createDataFrame([(1, 2, 0)], "src bigint, dst bigint, edge_type int")
    groups = spark.createDataFrame([("a",), ("empty",)], "seed string")
    layers = [(layer(4, 3), [layer(4, 3)])]
    out = M.graph_embedding(nodes, edges, "seed", ["id"], layers, heads, layer(4, 4), layer(5, 4), groups).collect()
    got = {r.seed: r.embedding for r in out}
    assert got["empty"] == [0.0] * 5 and len(got["a"]) == 5 and any(got["a"])


def test_heads_come_back_in_order_with_custom_ones(spark):
    rng = np.random.default_rng(2)
    names = ["mid_price", "regime_transition", "size"]
    layers = {n: [(rng.normal(size=(6, 3)), rng.normal(size=6)), (rng.normal(size=(M.HEADS[n][1], 6)), rng.normal(size=M.HEADS[n][1]))] for n in names}
    M.register_head("first", lambda x: (x[:, 0], np.ones(len(x))))
    x = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i bigint, x array<double>")
    got = {(r.i, r.head_name): (r.value, r.confidence) for r in M.score_heads(rows, "x", layers, [*names, "first"]).collect()}
    assert len(got) == 160
    for name in names:
        hidden = np.maximum(x @ layers[name][0][0].T + layers[name][0][1], 0)
        raw = M.ACTIVATIONS[M.HEADS[name][0]](hidden @ layers[name][1][0].T + layers[name][1][1])
        for i in range(40):
            value = raw[i].argmax() if name == "regime_transition" else raw[i, 0]
            assert got[i, name][0] == pytest.approx(value)
    assert all(got[i, "first"] == (pytest.approx(x[i, 0]), 1.0) for i in range(40))


def test_zscore_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(size=300)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t bigint, v double").withColumn("s", F.col("t"))
    got = {r.t: r.v_z for r in M.online_zscore(rows, ["t", "s"], ["v"]).collect()}
    for i in (1, 2, 50, 299):
        want = (x[i] - x[: i + 1].mean()) / np.sqrt(x[: i + 1].var(ddof=1) + 1e-8)
        assert got[i] == pytest.approx(want, abs=1e-4)


def test_weights_over_the_session_limit_are_refused(spark):
    df = spark.createDataFrame([("l", 0, 1, 3, [1.0, 2.0, 3.0], [0.0])], "layer string, part int, out_dim int, in_dim int, w array<double>, b array<double>")
    spark.conf.set(M.MAX_PARAMETERS_KEY, "3")
    try:
        with pytest.raises(ValueError, match="exceed"):
            M.weight_table(df)
    finally:
        spark.conf.unset(M.MAX_PARAMETERS_KEY)
    assert M.weight_table(df)[("l", 0)][0].tolist() == [[1.0, 2.0, 3.0]]


def test_trained_heads_learn(spark):
    """Each head beats the constant that is best for its loss."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 2))
    labels = np.digitize(x[:, 0], [-0.5, 0.5])
    noise = rng.normal(size=1200)
    rows = [
        (float(a), float(b), float(3 * a - b + 0.1 * e), bool(a > 0), bool(b > 0.3), float(2 + a + 0.2 * e), bool(a + b > 1), int(k))
        for (a, b), e, k in zip(x, noise, labels)
    ]
    kind = "a double, b double, mid_price_move_bp double, fill_occurred boolean, cancel_occurred boolean, slippage_bp double, vol_jump boolean, regime_label int"
    df = spark.createDataFrame(rows, kind)
    scored = T.predict_heads(df, T.train_heads(df, ["a", "b"]), ["a", "b"])
    got = scored.select("mid_price", "fill_prob", "cancel_prob", "slippage", "vol_jump_prob", "regime_probs").toPandas()
    y = np.array([r[2] for r in rows])
    assert np.abs(got.mid_price - y).mean() < 0.2
    for column, truth in [("fill_prob", [r[3] for r in rows]), ("cancel_prob", [r[4] for r in rows]), ("vol_jump_prob", [r[6] for r in rows])]:
        assert np.mean((got[column] > 0.5) == truth) > 0.93, column
    assert np.mean([np.argmax(p) == k for p, k in zip(got.regime_probs, labels)]) > 0.9
    s = np.array([r[5] for r in rows])
    loss = lambda d: np.where(d >= 0, 0.75 * d, -0.25 * d).mean()
    assert loss(s - got.slippage) < 0.7 * loss(s - np.quantile(s, 0.75))
