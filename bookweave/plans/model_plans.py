"""Vector, feature, loss and model queries (``embeddings``, ``events``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bookweave.functions import features as FE
from bookweave.functions import losses as LO
from bookweave.functions import vectors as V
from bookweave.operators import labels as L
from bookweave.operators import model as M
from bookweave.operators import training as T
from bookweave.plans import model_sql as MS
from bookweave.plans.catalog import query
from bookweave.plans.label_plans import ME, WIN, S, W
from bookweave.sources.driver_tables import ME_SQL, POLICY_SQL, market_events, model_events, policy_context, table

PO = f"WITH {POLICY_SQL} "
MO = f"WITH {ME_SQL}, mo AS (SELECT *, ts_exchange_ns AS ts_ns, ((qty_fp // 100000000 - 1) * 17 + symbol_id * 5) % 100 AS z FROM me) "
EM = "WITH em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS h FROM embeddings) "
EL = EM + ", el AS (SELECT vec_id, label, unnest(h) AS x, generate_subscripts(h, 1) - 1 AS pos FROM em) "


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("h"))


def r(name, digits=6):
    return F.round(name, digits).alias(name if isinstance(name, str) else "x")


@query(
    "activations",
    "H7",
    EL
    + """, sm AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM el)
 SELECT vec_id, pos, round(greatest(x, 0), 6) AS relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(CASE WHEN x > 20 THEN x ELSE ln(1 + exp(x)) END, 6) AS softplus,
 round(0.5::DOUBLE * x * (1 + ((exp(2 * u) - 1) / (exp(2 * u) + 1))), 6) AS gelu, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS softmax
 FROM (SELECT *, sqrt(2 / pi()) * (x + 0.044715::DOUBLE * x * x * x) AS u FROM sm)""",
)
def _(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(F.arrays_zip(F.col("h").alias("x"), V.softmax(F.col("h")).alias("s"))).alias("pos", "e"))
    x = F.col("e.x")
    out = {"relu": V.relu(x), "sigmoid": V.sigmoid(x), "softplus": V.softplus(x), "gelu": V.gelu(x), "softmax": F.col("e.s")}
    return rows.select("vec_id", "pos", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query(
    "vector_arithmetic",
    "H8 H9",
    EM
    + """SELECT vec_id, round(list_sum(list_transform(h, lambda x: 3 * x)), 6) AS tripled, round(list_dot_product(h, h), 6) AS dot, round(sqrt(list_dot_product(h, h)), 6) AS norm,
 round(list_sum(h[5:14]), 6) AS sliced, 2 * len(h) AS joined FROM em""",
)
def _(spark, d):
    h = F.col("h")
    return vectors(spark, d).select(
        "vec_id",
        F.round(V.vec_sum(V.vec_add(h, V.vec_scale(h, 2.0))), 6).alias("tripled"),
        F.round(V.vec_dot(h, h), 6).alias("dot"),
        F.round(V.vec_norm(h), 6).alias("norm"),
        F.round(V.vec_sum(V.vec_slice(h, 4, 10)), 6).alias("sliced"),
        F.size(V.vec_concat(h, h)).alias("joined"),
    )


def centroids(spark, d):
    """Mean vector per label: a 10 x 64 matrix worked out by Spark from the table."""
    return M.pools(vectors(spark, d), "label", "h").select("label", F.col("mean_pool").alias("q"))


CENT = EL + ", ce AS (SELECT label, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x) AS m FROM el GROUP BY 1, 2) GROUP BY 1) "


@query(
    "matrix_vector",
    "H10",
    CENT + "SELECT vec_id, ce.label AS row, round(list_dot_product(h, q) + ce.label / 10.0::DOUBLE, 6) AS y FROM em, ce",
)
def _(spark, d):
    parts = [layer for _, layer in sorted(M.weight_table(centroid_weights(spark, d)).items())]
    w, b = np.vstack([m for m, _ in parts]), np.concatenate([v for _, v in parts])
    y = vectors(spark, d).withColumn("y", M.dense_layer(F.col("h"), w, b))
    return y.select("vec_id", F.posexplode("y").alias("row", "y")).withColumn("y", F.round("y", 6))


@query(
    "vector_pools",
    "D32",
    EL + "SELECT label, pos, round(avg(x), 6) AS mean, round(sum(x), 5) AS total, round(max(x), 6) AS top FROM el GROUP BY 1, 2",
)
def _(spark, d):
    p = M.pools(vectors(spark, d), "label", "h")
    rows = p.select("label", F.posexplode(F.arrays_zip("mean_pool", "sum_pool", "max_pool")).alias("pos", "e"))
    return rows.select(
        "label", "pos", F.round("e.mean_pool", 6).alias("mean"), F.round("e.sum_pool", 5).alias("total"), F.round("e.max_pool", 6).alias("top")
    )


ZF = "SELECT ts_exchange_ns, seq, price_fp / 1e8 AS price, qty_fp / 1e8 AS qty FROM me"


@query(
    "feature_statistics",
    "D33",
    ME
    + f""", f AS ({ZF}) SELECT 'price' AS feature, round(avg(price), 6) AS mean, round(sqrt(var_samp(price) + 1e-8), 6) AS std FROM f UNION ALL SELECT 'qty', round(avg(qty), 6), round(sqrt(var_samp(qty) + 1e-8), 6) FROM f""",
)
def _(spark, d):
    e = market_events(spark, d).select((F.col("price_fp") / F.lit(1e8)).alias("price"), (F.col("qty_fp") / F.lit(1e8)).alias("qty"))
    return M.feature_statistics(e, ["price", "qty"]).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "online_zscore",
    "E31",
    ME
    + f""", f AS ({ZF}) SELECT seq, round(CASE WHEN n < 2 THEN price ELSE (price - mp) / sqrt(vp + 1e-8) END, 4) AS price_z, round(CASE WHEN n < 2 THEN qty ELSE (qty - mq) / sqrt(vq + 1e-8) END, 4) AS qty_z
 FROM (SELECT *, count(*) OVER w AS n, avg(price) OVER w AS mp, var_samp(price) OVER w AS vp, avg(qty) OVER w AS mq, var_samp(qty) OVER w AS vq FROM f WINDOW w AS (ORDER BY ts_exchange_ns, seq))""",
)
def _(spark, d):
    e = market_events(spark, d).select(
        "ts_exchange_ns", "seq", (F.col("price_fp") / F.lit(1e8)).alias("price"), (F.col("qty_fp") / F.lit(1e8)).alias("qty")
    )
    return M.online_zscore(e, ["ts_exchange_ns", "seq"], ["price", "qty"]).select("seq", F.round("price_z", 4).alias("price_z"), F.round("qty_z", 4).alias("qty_z"))


# --- scalar heads and losses -------------------------------------------------------------------------------


@query(
    "head_confidences",
    "H11",
    MO
    + """SELECT seq, round((z / 10.0::DOUBLE) / (z / 10.0::DOUBLE + 1), 6) AS mid, round(abs(2 * (z / 100.0::DOUBLE) - 1), 6) AS probability, round(1 / (1 + z / 10.0::DOUBLE), 6) AS slippage,
 round(greatest(0, (z / 100.0::DOUBLE - 1 / 3.0::DOUBLE) / (1 - 1 / 3.0::DOUBLE)), 6) AS class, round(1 - 2 * abs(z / 100.0::DOUBLE - 0.5::DOUBLE), 6) AS size FROM mo""",
)
def _(spark, d):
    ten, p = F.col("z") / F.lit(10.0), F.col("z") / F.lit(100.0)
    out = {
        "mid": V.mid_confidence(ten), "probability": V.probability_confidence(p), "slippage": V.slippage_confidence(ten),
        "class": V.class_confidence(p, 3), "size": V.size_confidence(p),
    }
    return model_events(spark, d).select("seq", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query(
    "losses",
    "H12 H13 H14 H15",
    MO
    + """, l AS (SELECT seq, z / 100.0::DOUBLE AS p, z / 10.0::DOUBLE AS m, (seq % 7)::DOUBLE AS t, (seq % 2)::DOUBLE AS y FROM mo)
 SELECT seq, round(CASE WHEN abs(m - t) <= 1 THEN 0.5::DOUBLE * (m - t) * (m - t) ELSE abs(m - t) - 0.5::DOUBLE END, 6) AS huber,
 round(-(y * ln(least(1 - 1e-7, greatest(1e-7, p))) + (1 - y) * ln(1 - least(1 - 1e-7, greatest(1e-7, p)))), 6) AS bce,
 round(-ln(greatest(1e-7, CASE WHEN y = 0 THEN p ELSE 1 - p END)), 6) AS ce, round(CASE WHEN t - m >= 0 THEN 0.75::DOUBLE * (t - m) ELSE -0.25::DOUBLE * (t - m) END, 6) AS quantile FROM l""",
)
def _(spark, d):
    p, m = F.col("z") / F.lit(100.0), F.col("z") / F.lit(10.0)
    t, y = F.pmod("seq", F.lit(7)).cast("double"), F.pmod("seq", F.lit(2)).cast("double")
    out = {
        "huber": LO.huber(m, t), "bce": LO.binary_cross_entropy(p, y),
        "ce": LO.cross_entropy(F.array(p, 1 - p), y.cast("int")), "quantile": LO.quantile(m, t, 0.75),
    }
    return model_events(spark, d).select("seq", *[F.round(c, 6).alias(n) for n, c in out.items()])


PRED = """, pr AS (SELECT *, ((window_index * 7) % 21 - 10)::DOUBLE AS mid_price, ((window_index * 13) % 100) / 100.0::DOUBLE AS fill_prob, ((window_index * 29) % 100) / 100.0::DOUBLE AS cancel_prob,
   CASE WHEN window_index % 5 <> 0 THEN ((window_index * 3) % 50)::DOUBLE END AS slippage, ((window_index * 31) % 100) / 100.0::DOUBLE AS vol_jump_prob, (window_index % 3)::DOUBLE AS regime_transition FROM lab),
 lb AS (SELECT *, lambda_bce(fill_prob, fill_occurred) AS lf, lambda_bce(cancel_prob, cancel_occurred) AS lc, 2 * lambda_bce(vol_jump_prob, vol_jump) AS lv,
   CASE WHEN abs(mid_price - mid_price_move_bp) <= 1 THEN 0.5::DOUBLE * (mid_price - mid_price_move_bp) ** 2 ELSE abs(mid_price - mid_price_move_bp) - 0.5::DOUBLE END AS lm,
   2 * CASE WHEN slippage_bp - slippage >= 0 THEN 0.75::DOUBLE * (slippage_bp - slippage) ELSE -0.25::DOUBLE * (slippage_bp - slippage) END AS ls,
   CASE WHEN regime_transition = regime_label THEN 0.0::DOUBLE ELSE 1.0 END AS lr FROM pr),
 ls AS (SELECT *, lm + lf + lc + coalesce(ls, 0) + lv + lr AS total FROM lb) """
import re  # noqa: E402

PRED = re.sub(
    r"lambda_bce\((\w+), (\w+)\)",
    r"-(CASE WHEN \2 THEN ln(least(1 - 1e-7, greatest(1e-7, \1))) ELSE ln(1 - least(1 - 1e-7, greatest(1e-7, \1))) END)",
    PRED,
)


def predicted(spark, d):
    """Labels with predictions that are arithmetic of the window number; the slippage head is absent
    in every fifth window."""
    k = F.col("window_index")
    share = lambda m: F.pmod(k * m, F.lit(100)) / F.lit(100.0)
    return L.label_rows(market_events(spark, d), W, S).withColumns(
        {
            "mid_price": (F.pmod(k * 7, F.lit(21)) - 10).cast("double"),
            "fill_prob": share(13),
            "cancel_prob": share(29),
            "slippage": F.when(k % 5 != 0, F.pmod(k * 3, F.lit(50)).cast("double")),
            "vol_jump_prob": share(31),
            "regime_transition": F.pmod(k, F.lit(3)).cast("double"),
        }
    )


@query("composite_loss", "H16", WIN + PRED + "SELECT window_index, round(total, 5) AS total FROM ls")
def _(spark, d):
    return predicted(spark, d).select("window_index", F.round(LO.composite()["total"], 5).alias("total"))


@query(
    "loss_means",
    "D34 J18",
    WIN
    + PRED
    + """SELECT unnest(['mid_price', 'fill_prob', 'cancel_prob', 'slippage', 'vol_jump', 'regime_transition', 'total']) AS head,
 unnest([round(avg(lm), 5), round(avg(lf), 5), round(avg(lc), 5), round(avg(ls), 5), round(avg(lv), 5), round(avg(lr), 5), round(avg(total), 5)]) AS loss FROM ls""",
)
def _(spark, d):
    return T.loss_means(predicted(spark, d)).withColumn("loss", F.round("loss", 5))


# --- features -------------------------------------------------------------------------------------------------


def props(spark, d):
    z = F.col("z").cast("double")
    keys = F.array(*[F.when(c, F.lit(k)) for c, k in [(F.lit(True), 0), (z % 2 == 0, 7), (z % 3 == 0, 8), (z % 5 != 0, 12), (F.lit(True), 16)]])
    keys = F.filter(keys, lambda k: k.isNotNull())
    return model_events(spark, d).select("seq", "event_type", F.map_from_arrays(keys, F.transform(keys, lambda k: z / 10 + k)).alias("p"))


PR = MO + """, pp AS (SELECT seq, event_type, z / 10.0::DOUBLE AS b, list_filter([0, CASE WHEN z % 2 = 0 THEN 7 END, CASE WHEN z % 3 = 0 THEN 8 END, CASE WHEN z % 5 <> 0 THEN 12 END, 16], lambda k: k IS NOT NULL) AS ks FROM mo) """


@query(
    "dense_node_features",
    "H17",
    PR
    + """SELECT seq, 17 AS n, round(b, 6) AS f0, round(CASE WHEN list_contains(ks, 7) THEN b + 7 ELSE 0.01 END, 6) AS f7, round(CASE WHEN list_contains(ks, 8) THEN b + 8 ELSE 0.5 END, 6) AS f8, 0.5::DOUBLE AS f9,
 round(CASE WHEN list_contains(ks, 12) THEN b + 12 ELSE 0 END, 6) AS f12, round(b + 16, 6) AS f16 FROM pp""",
)
def _(spark, d):
    rows = props(spark, d).withColumn("f", FE.dense_node_features(F.col("p")))
    return rows.select("seq", F.size("f").alias("n"), *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in (0, 7, 8, 9, 12, 16)])


@query(
    "dense_node_values",
    "H17",
    PR
    + """SELECT seq, k AS pos, round(CASE WHEN list_contains(ks, k) THEN b + k WHEN k = 7 THEN 0.01 WHEN k IN (8, 9) THEN 0.5 ELSE 0 END, 6) AS value FROM pp, generate_series(0, 16) AS t(k)""",
)
def _(spark, d):
    """All 17 values."""
    rows = props(spark, d).select("seq", F.posexplode(FE.dense_node_features(F.col("p"))).alias("pos", "value"))
    return rows.select("seq", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


@query(
    "edge_features",
    "H18",
    PR + """SELECT seq, round(event_type / 11.0::DOUBLE, 6) AS f0, round(b * len(ks) + list_sum(ks), 6) AS f1, len(ks)::DOUBLE AS f2, CASE WHEN event_type <= 1 THEN 0.0::DOUBLE WHEN event_type <= 5 THEN 0.5 ELSE 1.0 END AS f3 FROM pp""",
)
def _(spark, d):
    rows = props(spark, d).withColumn("f", FE.edge_features(F.col("event_type"), F.col("p")))
    return rows.select("seq", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(4)])


@query(
    "packed_features",
    "H19 H20",
    PR
    + """SELECT seq, round(event_type / 10.0::DOUBLE, 6) AS f0, round(b, 6) AS f1, round(b + ks[2], 6) AS f2, round(CASE WHEN len(ks) >= 3 THEN b + ks[3] ELSE 0 END, 6) AS f3, 0.0::DOUBLE AS f7, 17 AS wide, round(event_type / 10.0::DOUBLE + b * len(ks) + list_sum(ks), 6) AS total FROM pp""",
)
def _(spark, d):
    rows = props(spark, d).withColumn("f", FE.packed_features(F.col("event_type"), F.col("p"), 10.0))
    wide = FE.widen_features(F.col("f"))
    return rows.select(
        "seq", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in (0, 1, 2, 3, 7)], F.size(wide).alias("wide"), F.round(V.vec_sum(wide), 6).alias("total")
    )


@query(
    "packed_values",
    "H19 H20",
    PR
    + """SELECT seq, k AS pos, round(CASE WHEN k = 0 THEN event_type / 10.0::DOUBLE WHEN k <= len(ks) THEN b + ks[k] ELSE 0 END, 6) AS value FROM pp, generate_series(0, 16) AS t(k)""",
)
def _(spark, d):
    """The 8 packed values and the zeros that widen them to 17."""
    wide = FE.widen_features(FE.packed_features(F.col("event_type"), F.col("p"), 10.0))
    rows = props(spark, d).select("seq", F.posexplode(wide).alias("pos", "value"))
    return rows.select("seq", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


# --- ranking ---------------------------------------------------------------------------------------------------


@query(
    "best_prediction",
    "F8",
    PO
    + """, h AS (SELECT seq, unnest(['place', 'modify', 'cancel']) AS head_name, unnest([place_v, modify_v, cancel_v]) AS value, unnest([0, 1, 2]) AS idx, unnest([round(abs(2 * place_v - 1), 6), round(abs(2 * modify_v - 1), 6), round(abs(2 * cancel_v - 1), 6)]) AS confidence FROM hd)
 SELECT seq, head_name, idx, value, confidence FROM h QUALIFY row_number() OVER (PARTITION BY seq ORDER BY confidence DESC, idx) = 1""",
)
def _(spark, d):
    signal = lambda i, n: F.struct(
        F.lit(n).alias("head_name"), F.lit(i).alias("idx"), F.col(f"{n}_signal").alias("value"),
        F.round(V.probability_confidence(F.col(f"{n}_signal")), 6).alias("confidence"),
    )
    rows = policy_context(spark, d).select("seq", F.inline(F.array(*[signal(i, n) for i, n in enumerate(["place", "modify", "cancel"])])))
    return M.best_prediction(rows, ["seq"], "idx")


@query(
    "arg_max_class",
    "F9",
    EL + "SELECT vec_id, round(max(x), 6) AS top, min(pos) FILTER (x = m)::BIGINT AS class FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM el) GROUP BY 1",
)
def _(spark, d):
    return vectors(spark, d).select("vec_id", F.round(F.array_max("h"), 6).alias("top"), V.arg_max(F.col("h")).alias("class"))


NEAR = CENT + """SELECT query_id, id, rank, round(distance, 6) AS distance FROM (SELECT ce.label AS query_id, vec_id AS id, 1 - list_dot_product(h, q) / (sqrt(list_dot_product(h, h)) * sqrt(list_dot_product(q, q))) AS distance,
 row_number() OVER (PARTITION BY ce.label ORDER BY 1 - list_dot_product(h, q) / (sqrt(list_dot_product(h, h)) * sqrt(list_dot_product(q, q))), vec_id) AS rank FROM em, ce) WHERE rank <= 10"""


@query("nearest_embeddings", "F12", NEAR)
def _(spark, d):
    corpus = vectors(spark, d).select(F.col("vec_id").alias("id"), "h")
    found = M.nearest(corpus, centroids(spark, d).withColumnRenamed("label", "query_id"), 10)
    return found.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def twentieths(spark, d):
    """Every row whose id is divisible by 20, as a query against all rows."""
    return vectors(spark, d).filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("q"))


@query(
    "nearest_to_twentieths",
    "F12",
    EM
    + """, un AS (SELECT vec_id, h, sqrt(list_dot_product(h, h)) AS n FROM em) SELECT query_id, id, rank, round(distance, 6) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS id,
 1 - list_dot_product(a.h, b.h) / (a.n * b.n) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_dot_product(a.h, b.h) / (a.n * b.n), 12), b.vec_id) AS rank FROM un a, un b WHERE a.vec_id % 20 = 0) WHERE rank <= 10""",
)
def _(spark, d):
    corpus = vectors(spark, d).select(F.col("vec_id").alias("id"), "h")
    return M.nearest(corpus, twentieths(spark, d), 10).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query("nearest_embeddings_lsh", "F12")
def _(spark, d):
    """The approximate form; tests measure its recall against the exact one."""
    corpus = vectors(spark, d).select(F.col("vec_id").alias("id"), "h")
    return M.nearest_lsh(corpus, twentieths(spark, d), 10).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query(
    "hybrid_scores",
    "F13",
    MO + """SELECT seq, round(z / 100.0::DOUBLE * 0.4 + (seq % 97) / 97.0::DOUBLE * 0.25 + (seq % 31) / 31.0::DOUBLE * 0.2 + (seq % 13) / 13.0::DOUBLE * 0.15, 9) AS score FROM mo ORDER BY score DESC, seq LIMIT 50""",
)
def _(spark, d):
    part = lambda n: F.pmod("seq", F.lit(n)) / F.lit(float(n))
    rows = model_events(spark, d).select("seq", (F.col("z") / F.lit(100.0)).alias("a"), part(97).alias("b"), part(31).alias("c"), part(13).alias("e"))
    return M.hybrid_scores(rows, ["a", "b", "c", "e"], 50, "seq").select("seq", F.round("score", 9).alias("score"))


@query(
    "composed_families",
    "J12",
    EM
    + """SELECT vec_id, 512 AS n, round(list_sum(h) * 3 + CASE WHEN label % 2 = 0 THEN list_sum(h) ELSE 0 END, 6) AS total, round(list_sum(h), 6) AS queue_total FROM em""",
)
def _(spark, d):
    """64-wide vectors in three families, one family absent for odd labels, the others absent."""
    none = F.lit(None).cast("array<double>")
    rows = vectors(spark, d).withColumns(
        {
            "book_state": none, "queue_state": F.col("h"), "event_stream": none, "cross_symbol_regime": F.col("h"),
            "strategy_context": F.when(F.col("label") % 2 == 0, F.col("h")), "risk_context": F.col("h"),
        }
    ).withColumn("v", M.compose())
    queue = M.decompose(F.col("v"))["queue_state"]
    return rows.select("vec_id", F.size("v").alias("n"), F.round(V.vec_sum(F.col("v")), 6).alias("total"), F.round(V.vec_sum(queue), 6).alias("queue_total"))


# --- scoring -----------------------------------------------------------


def parameters(spark, shapes: list[tuple[str, int, int, int]]):
    """A weight table (layer, part, out_dim, in_dim, w, b) from a fixed rule."""
    spec = spark.createDataFrame(shapes, "layer string, part int, out_dim int, in_dim int")
    cell = lambda i: (F.pmod(i * 31 + F.col("part") * 7 + F.length("layer") * 11, F.lit(19)) - 9) / F.lit(60.0)
    ids = lambda n: F.sequence(F.lit(0), n - 1)
    return spec.withColumns(
        {"w": F.transform(ids(F.col("out_dim") * F.col("in_dim")), cell), "b": F.transform(ids(F.col("out_dim")), lambda i: i / F.lit(100.0))}
    )


def centroid_weights(spark, d):
    """One weight row per label: its centroid, and label / 10 as bias."""
    return centroids(spark, d).select(
        "label", F.lit("centroid").alias("layer"), F.col("label").alias("part"), F.lit(1).alias("out_dim"), F.size("q").alias("in_dim"),
        F.col("q").alias("w"), F.array(F.col("label") / 10).alias("b"),
    )


@query(
    "weight_table",
    "J1",
    CENT + "SELECT label, 64 AS n_w, 1 AS n_b, round(list_sum(q), 6) AS w_total FROM ce",
)
def _(spark, d):
    """One row of weights per label, worked out from the table and checked for size."""
    rows = centroid_weights(spark, d)
    return M.checked_weights(rows).select("label", F.size("w").alias("n_w"), F.size("b").alias("n_b"), F.round(V.vec_sum(F.col("w")), 6).alias("w_total"))


def node_table(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), F.pmod("vec_id", F.lit(7)).alias("seed"), "h")


def edge_table(spark, d):
    v = table(spark, d, "embeddings")
    n = v.select(F.count(F.lit(1))).scalar()
    pairs = F.array(
        F.struct((F.col("vec_id") + 1).alias("dst"), F.lit(0).alias("step")),
        F.struct(F.pmod(F.col("vec_id") * 7, n).alias("dst"), F.lit(1).alias("step")),
    )
    rows = v.select(F.col("vec_id").alias("src"), F.inline(pairs)).filter(F.col("dst") < n)
    return rows.select("src", "dst", F.pmod(F.col("src") + F.col("step"), F.lit(12)).cast("int").alias("edge_type"))


def message_layers(spark, dims):
    shapes = [(f"self{i}", 0, o, n) for i, (n, o) in enumerate(dims)] + [(f"type{i}", t, o, n) for i, (n, o) in enumerate(dims) for t in range(12)]
    w = M.weight_table(parameters(spark, shapes))
    return [(w[(f"self{i}", 0)], [w[(f"type{i}", t)] for t in range(12)]) for i in range(len(dims))]


def attention_heads(spark, width, head_dim, out):
    names = ["q", "k", "v"]
    w = M.weight_table(parameters(spark, [(n, h, head_dim, width) for n in names for h in range(4)] + [("out", 0, out, 4 * head_dim)]))
    return [{n: w[(n, h)] for n in names} for h in range(4)], w[("out", 0)]


def flat(df, *columns):
    """The whole vector, one row per number."""
    return df.select(*columns[:-1], F.posexplode(columns[-1]).alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("message_passing", "J2 C12 C13", MS.MESSAGES)
def _(spark, d):
    ((self_layer, types),) = message_layers(spark, [(64, 16)])
    return flat(M.message_passing(node_table(spark, d), edge_table(spark, d), self_layer, types), "id", "h")


@query("stacked_message_passing", "J3", MS.STACKED_MESSAGES)
def _(spark, d):
    return flat(M.stacked_message_passing(node_table(spark, d), edge_table(spark, d), message_layers(spark, [(64, 16), (16, 16)])), "id", "h")


@query("attention_pool", "J4", MS.ATTENTION_POOL)
def _(spark, d):
    heads, out = attention_heads(spark, 64, 16, 32)
    return flat(M.attention_pool(node_table(spark, d), "seed", ["id"], heads, out)[0], "seed", "pooled")


@query("attention_weights", "J4", MS.ATTENTION_WEIGHTS)
def _(spark, d):
    heads, out = attention_heads(spark, 64, 16, 32)
    return M.attention_pool(node_table(spark, d), "seed", ["id"], heads, out)[1].withColumn("weight", F.round("weight", 6))


@query("graph_embedding", "J5", MS.GRAPH_EMBEDDING)
def _(spark, d):
    heads, out = attention_heads(spark, 16, 4, 16)
    project = M.weight_table(parameters(spark, [("embed", 0, 512, 16)]))[("embed", 0)]
    layers = message_layers(spark, [(64, 16), (16, 16)])
    return flat(M.graph_embedding(node_table(spark, d), edge_table(spark, d), "seed", ["id"], layers, heads, out, project), "seed", "embedding")


def families(spark, d):
    shapes = [(n, 0, width, 128 if n == "strategy_context" else 64) for n, width in M.FAMILIES]
    w = M.weight_table(parameters(spark, shapes))
    return M.embed_families(M.family_pools(node_table(spark, d), "seed", ["id"]), "seed", {n: w[(n, 0)] for n, _ in M.FAMILIES})


for _name, _ids in zip(["book_state", "queue_state", "event_stream", "cross_symbol_regime", "strategy_context", "risk_context"], ["J6", "J7", "J8", "J9", "J10", "J11"]):

    def _one(name):
        def run(spark, d):
            return flat(families(spark, d), "seed", name)

        return run

    query(f"family_{_name}", _ids, MS.family(_name, M.FAMILIES))(_one(_name))


@query("composed_embedding", "J12", MS.composed(M.FAMILIES))
def _(spark, d):
    return flat(families(spark, d).withColumn("v", M.compose()), "seed", "v")


def mlp_layers(spark, outputs, width=64, hidden=32):
    w = M.weight_table(parameters(spark, MS.mlp_shapes(outputs, width, hidden)))
    return {n: [w[(f"{n}_0", 0)], w[(f"{n}_1", 0)]] for n in outputs}


@query("mlp_forward", "J13", MS.MLP)
def _(spark, d):
    layers = mlp_layers(spark, {"net": 3})["net"]
    return flat(vectors(spark, d).withColumn("y", M.mlp(F.col("h"), layers, "relu", "sigmoid")), "vec_id", "y")


def head_scores(spark, d, names):
    layers = mlp_layers(spark, {n: M.HEADS[n][1] for n in names})
    return M.score_heads(vectors(spark, d), "h", layers, names).select("vec_id", "head_name", F.round("value", 6).alias("value"), F.round("confidence", 6).alias("confidence"))


@query("prediction_heads", "J14", MS.heads({n: M.HEADS[n] for n in M.PREDICTION_HEADS}))
def _(spark, d):
    return head_scores(spark, d, M.PREDICTION_HEADS)


@query("control_heads", "J15", MS.heads({n: M.HEADS[n] for n in M.CONTROL_HEADS}))
def _(spark, d):
    return head_scores(spark, d, M.CONTROL_HEADS)


@query("all_heads", "J16", MS.heads(M.HEADS))
def _(spark, d):
    return head_scores(spark, d, list(M.HEADS))


@query("custom_head", "L1", EM + "SELECT vec_id, 'norm' AS head_name, round(sqrt(list_dot_product(h, h)), 6) AS value, 1.0::DOUBLE AS confidence FROM em")
def _(spark, d):
    M.register_head("norm", lambda x: ((x * x).sum(axis=1) ** 0.5, np.ones(len(x))))
    return M.score_heads(vectors(spark, d), "h", {}, ["norm"]).select("vec_id", "head_name", F.round("value", 6).alias("value"), "confidence")


@query("custom_family", "L2", EL + "SELECT vec_id % 7 AS seed, pos, round(max(x), 6) AS top FROM el GROUP BY 1, 2")
def _(spark, d):
    M.register_family("peak", 64, lambda nodes, key: M.pools(nodes, key, "h").select(key, F.col("max_pool").alias("vector")))
    rows = M.custom_family(node_table(spark, d), "seed", "peak")
    return rows.select("seed", F.posexplode("vector").alias("pos", "top")).withColumn("top", F.round("top", 6))


FEATURES = ["n_events", "ret_std", "ret_mean", "spread"]


def training_rows(spark, d):
    events = market_events(spark, d)
    grid = L.Windows.over(events, W, S)
    stats = L.trade_slippage(events, L.window_statistics(events, grid), grid)
    return stats.select(
        "window_index",
        (F.col("n_events") / F.lit(100.0)).alias("n_events"),
        (F.coalesce("ret_std", F.lit(0.0)) * 1000).alias("ret_std"),
        (F.coalesce("ret_mean", F.lit(0.0)) * 1000).alias("ret_mean"),
        (F.coalesce(F.col("ret_max") - F.col("ret_min"), F.lit(0.0)) * 1000).alias("spread"),
        L.mid_move_bp().alias("mid_price_move_bp"), "fill_occurred", "cancel_occurred", "slippage_bp",
        L.vol_jump().alias("vol_jump"), L.regime_label().alias("regime_label"),
    )


@query("trained_head_losses", "J17 J18")
def _(spark, d):
    from bookweave.session import cut_lineage

    rows = cut_lineage(L.split_train_val(training_rows(spark, d), 0.2))
    models = T.train_heads(rows.filter("split = 'train'"), FEATURES)
    scored = T.predict_heads(rows.filter("split = 'val'"), models, FEATURES).withColumn("regime_transition", F.lit(None).cast("double"))
    return T.loss_means(scored, probabilities="regime_probs").withColumn("loss", F.round("loss", 6))
