"""Scoring and training on embeddings: pools, message passing, attention, families, heads.

Matrices are small parameter tables (size-checked), applied to Arrow batches with numpy. Sums over
groups use Spark's own vector aggregate (``Summarizer``), which pre-aggregates on the map side, so no
group is ever collected: hubs and hot groups cost one partial row per task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.vectors import vec_norm
from bookweave.operators.nearest import nearest, nearest_lsh  # noqa: F401
from bookweave.operators.ordered import count_of, running

#: Parameters that a session lets come to the driver (8 bytes each), unless this setting says otherwise.
MAX_PARAMETERS, MAX_PARAMETERS_KEY = 50_000_000, "spark.bookweave.maxParameters"


# --- weights ----------------------------------------------------------------------------------------


def weight_table(df: DataFrame, version: int | None = None) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Load (layer, part, out_dim, in_dim, w, b[, version]) rows as matrices; shapes are asserted in
    Spark and the total size is checked before anything comes to the driver."""
    if version is not None:
        df = df.filter(F.col("version") == version)
    size = df.agg(F.sum(F.size("w") + F.size("b"))).first()[0] or 0
    limit = int(df.sparkSession.conf.get(MAX_PARAMETERS_KEY, str(MAX_PARAMETERS)))
    if size > limit:
        raise ValueError(f"{size} parameters exceed {MAX_PARAMETERS_KEY} = {limit}")
    checked = checked_weights(df)
    return {
        (r["layer"], r["part"]): (np.array(r["w"]).reshape(r["out_dim"], r["in_dim"]), np.array(r["b"]))
        for r in checked.collect()
    }


def checked_weights(df: DataFrame) -> DataFrame:
    """Weight rows whose arrays have the stated sizes; a wrong size fails the job."""
    ok = (F.size("w") == F.col("out_dim") * F.col("in_dim")) & (F.size("b") == F.col("out_dim"))
    return df.withColumn(
        "w", F.when(ok, F.col("w")).otherwise(F.raise_error(F.format_string("bad weight size in %s", "layer")).cast("array<double>"))
    )


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "linear": lambda x: x,
    "relu": lambda x: np.maximum(x, 0.0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "softplus": lambda x: np.where(x > 20, x, np.log1p(np.exp(np.minimum(x, 20)))),
    "softmax": lambda x: np.exp(x - x.max(axis=1, keepdims=True)) / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True),
}


def dense_layer(vector: Column, w: np.ndarray, b: np.ndarray, activation: str = "linear") -> Column:
    """activation(W x + b) over Arrow batches."""
    act = ACTIVATIONS[activation]

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(act(_stack(v) @ w.T + b)))

    return apply(vector)


def mlp(vector: Column, layers: list[tuple[np.ndarray, np.ndarray]], hidden: str, output: str) -> Column:
    """A layer list in one pass over each batch."""

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        x = _stack(v)
        for i, (w, b) in enumerate(layers):
            x = ACTIVATIONS[output if i == len(layers) - 1 else hidden](x @ w.T + b)
        return pd.Series(list(x))

    return apply(vector)


# --- pools and statistics ------------------------------------------------------------------------------


def pools(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean, sum and max per group."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    stats = rows.withColumn("_v", v).groupBy(key).agg(
        Summarizer.metrics("mean", "sum", "max").summary(F.col("_v")).alias("s")
    )
    return stats.select(
        key, *[vector_to_array(f"s.{m}").alias(f"{m}_pool") for m in ("mean", "sum", "max")]
    )


def feature_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    """Mean and standard deviation (sample, +1e-8) per feature, as long rows."""
    parts = [
        F.struct(
            F.lit(f).alias("feature"),
            F.avg(f).alias("mean"),
            F.when(F.count(f) < 2, F.lit(1.0)).otherwise(F.sqrt(F.var_samp(f) + 1e-8)).alias("std"),
        )
        for f in features
    ]
    return rows.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def online_zscore(rows: DataFrame, order: list[str], features: list[str]) -> DataFrame:
    """Each row normalised with the statistics of the rows up to and including it (raw below two
    rows). Values are shifted by the overall mean, so that the running squares keep their digits however far from
    zero the values lie."""
    from bookweave.operators.ordered import sum_of

    base = rows.agg(*[F.avg(f).alias(f) for f in features]).first()
    shift = {f: float(base[f] or 0.0) for f in features}
    values = {"_n": count_of()}
    for f in features:
        x = F.col(f) - shift[f]
        values[f"_s_{f}"] = sum_of(x)
        values[f"_q_{f}"] = sum_of(x * x)
    out = running(rows, [], order, **values)
    n = F.col("_n")

    def z(f: str) -> Column:
        mean = F.col(f"_s_{f}") / n
        var = F.greatest(F.lit(0.0), (F.col(f"_q_{f}") - mean * F.col(f"_s_{f}")) / (n - 1))
        return F.when(n < 2, F.col(f)).otherwise((F.col(f) - shift[f] - mean) / F.sqrt(var + 1e-8))

    return out.select(*rows.columns, *[z(f).alias(f"{f}_z") for f in features])


# --- message passing --------------------------------------------------------------------------------------


def message_passing(
    nodes: DataFrame, edges: DataFrame, self_layer: tuple[np.ndarray, np.ndarray],
    type_layers: list[tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """relu(W_self h + mean over in-edges of W_type h_src); nodes (id, h), edges (src, dst, edge_type).

    W is linear, so source vectors are summed per (dst, type) first and multiplied once per pair, not
    once per edge.
    """
    n_types = len(type_layers)
    vec = array_to_vector(F.col("h"))
    source = nodes.select(F.col("id").alias("src"), vec.alias("v"))
    summed = (
        edges.select("src", "dst", F.pmod("edge_type", F.lit(n_types)).cast("int").alias("type"))
        .join(source, "src")
        .groupBy("dst", "type")
        .agg(Summarizer.metrics("sum", "count").summary(F.col("v")).alias("s"))
        .select("dst", "type", vector_to_array("s.sum").alias("total"), F.col("s.count").alias("n"))
    )
    ws = np.stack([w for w, _ in type_layers])
    bs = np.stack([b for _, b in type_layers])

    @F.pandas_udf("array<double>")
    def message(total: pd.Series, kind: pd.Series, n: pd.Series) -> pd.Series:
        k = kind.to_numpy()
        return pd.Series(list(np.einsum("noi,ni->no", ws[k], _stack(total)) + bs[k] * n.to_numpy()[:, None]))

    messages = (
        summed.withColumn("_m", array_to_vector(message("total", "type", "n")))
        .groupBy("dst")
        .agg(Summarizer.sum(F.col("_m")).alias("_sum"), F.sum("n").alias("_n"))
        .select(F.col("dst").alias("id"), vector_to_array("_sum").alias("_msg"), "_n")
    )
    w0, b0 = self_layer

    @F.pandas_udf("array<double>")
    def update(h: pd.Series, msg: pd.Series, n: pd.Series) -> pd.Series:
        out = _stack(h) @ w0.T + b0
        count = n.fillna(0).to_numpy(dtype=np.float64)
        met = np.flatnonzero(count)
        if len(met):
            out[met] += _stack(msg.iloc[met]) / count[met, None]
        return pd.Series(list(np.maximum(out, 0.0)))

    joined = nodes.join(messages, "id", "left")
    return joined.withColumn("h", update("h", "_msg", "_n")).drop("_msg", "_n")


def stacked_message_passing(nodes: DataFrame, edges: DataFrame, layers: list) -> DataFrame:
    """Rounds of ``(self_layer, type_layers)``."""
    for self_layer, type_layers in layers:
        nodes = message_passing(nodes, edges, self_layer, type_layers)
    return nodes


# --- attention -----------------------------------------------------------------------------------------------


def attention_pool(
    rows: DataFrame, key: str, order: list[str], heads: list[dict[str, tuple[np.ndarray, np.ndarray]]],
    out_layer: tuple[np.ndarray, np.ndarray], mask: str | None = None, groups: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Multi-head attention pool per group, query = last position: (pooled per group, weight per row).

    Scores, softmax and the weighted sum are ordinary aggregates: q.k is a dot product of the row with
    one vector per (group, head), and the weighted value sum is W_v applied to the weighted mean of the
    rows, so no sequence is ever collected. ``heads``: dicts with q, k, v layers. Groups without rows
    (given by ``groups``) come out as zeros.
    """
    n_heads = len(heads)
    scale = 1 / np.sqrt(heads[0]["q"][0].shape[0])
    # score = scale * (Wq x_last + bq) . (Wk x + bk) = u . x + c
    last = rows.groupBy(key).agg(F.max_by("h", F.struct(*order)).alias("_last"))

    @F.pandas_udf("array<array<double>>")
    def queries(x: pd.Series) -> pd.Series:
        v = _stack(x)
        parts = []
        for head in heads:
            q = (v @ head["q"][0].T + head["q"][1]) * scale
            parts.append(np.concatenate([q @ head["k"][0], (q @ head["k"][1])[:, None]], axis=1))
        return pd.Series([list(map(list, np.stack([p[i] for p in parts]))) for i in range(len(v))])

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series, u: pd.Series) -> pd.Series:
        v = _stack(x)
        m = np.array([np.stack(list(a)) for a in u])
        return pd.Series(list(np.einsum("nhi,ni->nh", m[:, :, :-1], v) + m[:, :, -1]))

    scored = rows.join(last.select(key, queries("_last").alias("_u")), key).withColumn("_s", scores("h", "_u")).drop("_u")
    if mask is not None:
        scored = scored.withColumn("_s", F.when(F.col(mask), F.col("_s")).otherwise(F.array_repeat(F.lit(-1e9), n_heads)))
    tops = scored.groupBy(key).agg(*[F.max(F.col("_s")[i]).alias(f"_m{i}") for i in range(n_heads)])
    weighted = scored.join(tops, key).select(
        key, *order, "h", *[F.exp(F.col("_s")[i] - F.col(f"_m{i}")).alias(f"_e{i}") for i in range(n_heads)]
    )
    v = array_to_vector(F.col("h"))
    pooled = weighted.withColumn("_v", v).groupBy(key).agg(
        *[Summarizer.mean(F.col("_v"), F.col(f"_e{i}")).alias(f"_p{i}") for i in range(n_heads)],
        *[F.sum(f"_e{i}").alias(f"_z{i}") for i in range(n_heads)],
    )
    wo, bo = out_layer

    @F.pandas_udf("array<double>")
    def project(*means: pd.Series) -> pd.Series:
        parts = [_stack(m) @ head["v"][0].T + head["v"][1] for m, head in zip(means, heads)]
        return pd.Series(list(np.concatenate(parts, axis=1) @ wo.T + bo))

    output = pooled.select(key, project(*[vector_to_array(f"_p{i}") for i in range(n_heads)]).alias("pooled"))
    if groups is not None:
        zeros = F.array_repeat(F.lit(0.0), int(wo.shape[0]))
        output = groups.select(key).join(output, key, "left").withColumn("pooled", F.coalesce("pooled", zeros))
    sums = pooled.select(key, *[f"_z{i}" for i in range(n_heads)])
    share = sum((F.col(f"_e{i}") / F.col(f"_z{i}") for i in range(n_heads)), F.lit(0.0)) / n_heads
    weights = weighted.join(sums, key).select(key, *order, share.alias("weight"))
    return output, weights


def graph_embedding(
    nodes: DataFrame, edges: DataFrame, key: str, order: list[str], layers: list, heads: list,
    attention_out: tuple[np.ndarray, np.ndarray], project: tuple[np.ndarray, np.ndarray], groups: DataFrame | None = None,
) -> DataFrame:
    """Message rounds, attention pool per group, projection, relu. ``nodes``: (id, key, order.., h). A group of
    ``groups`` without nodes has an embedding of zeros."""
    passed = stacked_message_passing(nodes, edges, layers)
    pooled, _ = attention_pool(passed, key, order, heads, attention_out)
    embedded = pooled.withColumn("embedding", dense_layer(F.col("pooled"), *project, "relu")).drop("pooled")
    if groups is None:
        return embedded
    zeros = F.array_repeat(F.lit(0.0), int(project[0].shape[0]))
    return groups.select(key).distinct().join(embedded, key, "left").withColumn("embedding", F.coalesce("embedding", zeros))


# --- embedding families -----------------------------------------------------------------------------------------

# Families in composition order with their widths.
FAMILIES = [
    ("book_state", 128), ("queue_state", 64), ("event_stream", 128),
    ("cross_symbol_regime", 64), ("strategy_context", 64), ("risk_context", 64),
]
KINDS = {
    "book_state": [0, 2], "queue_state": [3], "event_stream": [5, 4],
    "cross_symbol_regime": [0, 8], "risk_context": [8, 9, 7],
}


def family_pools(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Pooled vector of every family per group, null where a family has no node. Rows (key, kind, h,
    order..).

    A node becomes one row per family it counts in, with its weight (softmax of norms for the book,
    0.9 per later event for the stream, else 1); one weighted aggregate then serves all families.
    """
    of = lambda name: F.col("kind").isin(KINDS[name])
    rows = nodes.withColumn("_norm", F.when(of("book_state"), vec_norm(F.col("h"))))
    tops = rows.groupBy(key).agg(F.max("_norm").alias("_top"))
    back = [f"_b{i}" for i in range(len(order))]
    rows = rows.withColumns({b: -F.col(o) for b, o in zip(back, order)})
    rows = running(rows, [key], back, _later=count_of(of("event_stream"))).drop("_chunk")
    weight = {
        "book_state": F.exp(F.col("_norm") - F.col("_top")),
        "event_stream": F.pow(F.lit(0.9), F.col("_later") - 1),
    }
    parts = F.array(
        *[
            F.when(of(n), F.struct(F.lit(n).alias("family"), weight.get(n, F.lit(1.0)).alias("w")))
            for n in KINDS
        ]
    )
    spread = rows.join(tops, key).select(
        key, array_to_vector(F.col("h")).alias("_v"), F.inline(F.filter(parts, lambda p: p.isNotNull()))
    )
    stats = spread.groupBy(key, "family").agg(
        Summarizer.metrics("mean", "sum", "max").summary(F.col("_v"), F.col("w")).alias("s")
    )
    use = {"queue_state": "sum", "risk_context": "max"}
    wide = stats.groupBy(key).agg(
        *[
            F.first(F.when(F.col("family") == n, vector_to_array(f"s.{use.get(n, 'mean')}")), ignorenulls=True).alias(n)
            for n in KINDS
        ]
    )
    first = lambda kind: F.min_by("h", F.when(F.col("kind") == kind, F.struct(*order)))
    context = nodes.groupBy(key).agg(
        first(9).alias("_strategy"), first(6).alias("_participant"), F.first(F.size("h")).alias("_dim")
    )
    zero = F.array_repeat(F.lit(0.0), F.col("_dim"))
    strategy = F.concat(F.coalesce("_strategy", zero), F.coalesce("_participant", zero))
    return context.join(wide, key, "left").withColumn("strategy_context", strategy).select(
        key, *[n for n, _ in FAMILIES]
    )


FamilyPool = Callable[[DataFrame, str], DataFrame]
_CUSTOM_FAMILIES: dict[str, tuple[int, FamilyPool]] = {}


def register_family(name: str, dimension: int, pool: FamilyPool) -> None:
    """A family of the user's own: ``pool(nodes, key)`` gives (key, vector)."""
    _CUSTOM_FAMILIES[name] = (dimension, pool)


def embed_families(pooled: DataFrame, key: str, layers: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Project each family's pool and apply relu; a family without nodes is zeros."""
    out = [F.col(key)]
    for name, width in FAMILIES:
        w, b = layers[name]
        zeros = F.array_repeat(F.lit(0.0), w.shape[0])
        safe = F.coalesce(name, F.array_repeat(F.lit(0.0), w.shape[1]))
        projected = dense_layer(safe, w, b, "relu")
        out.append(F.when(F.col(name).isNotNull(), projected).otherwise(zeros).alias(name))
    return pooled.select(*out)


def custom_family(nodes: DataFrame, key: str, name: str) -> DataFrame:
    return _CUSTOM_FAMILIES[name][1](nodes, key)


def compose(families: list[tuple[str, int]] = FAMILIES) -> Column:
    """Six family columns into one vector: missing ones are zeros, a wrong width fails."""
    parts = []
    for name, width in families:
        v = F.col(name)
        wrong = F.raise_error(F.format_string(f"{name}: %d values instead of {width}", F.size(v))).cast("array<double>")
        parts.append(
            F.when(v.isNull(), F.array_repeat(F.lit(0.0), width)).when(F.size(v) == width, v).otherwise(wrong)
        )
    return F.concat(*parts)


def decompose(vector: Column, families: list[tuple[str, int]] = FAMILIES) -> dict[str, Column]:
    at, out = 1, {}
    for name, width in families:
        out[name] = F.slice(vector, at, width)
        at += width
    return out


# --- heads ------------------------------------------------------------------------------------------------------

Head = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
HEADS: dict[str, tuple[str, int, str]] = {
    # name: (output activation, classes, confidence rule)
    "mid_price": ("linear", 1, "mid"),
    "fill_prob": ("sigmoid", 1, "probability"),
    "cancel_prob": ("sigmoid", 1, "probability"),
    "slippage": ("softplus", 1, "slippage"),
    "vol_jump": ("sigmoid", 1, "probability"),
    "regime_transition": ("softmax", 3, "class"),
    "place": ("sigmoid", 1, "probability"),
    "modify": ("sigmoid", 1, "probability"),
    "size": ("sigmoid", 1, "size"),
    "venue": ("softmax", 4, "class"),
    "write_admission": ("sigmoid", 1, "probability"),
}
PREDICTION_HEADS = list(HEADS)[:6]
CONTROL_HEADS = list(HEADS)[6:]
_CUSTOM_HEADS: dict[str, Head] = {}


def register_head(name: str, head: Head) -> None:
    """A head of the user's own: a function from a batch matrix to (values, confidences)."""
    _CUSTOM_HEADS[name] = head


def _head_values(rule: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if rule == "class":
        best, n = raw.argmax(axis=1), raw.shape[1]
        return best.astype(float), np.maximum(0.0, (raw.max(axis=1) - 1 / n) / (1 - 1 / n))
    p = raw[:, 0]
    confidence = {
        "mid": lambda: np.abs(p) / (np.abs(p) + 1),
        "probability": lambda: np.abs(2 * p - 1),
        "slippage": lambda: 1 / (1 + p),
        "size": lambda: 1 - np.abs(p - 0.5) * 2,
    }[rule]()
    return p, confidence


def score_heads(
    rows: DataFrame, vector: str, layers: dict[str, list[tuple[np.ndarray, np.ndarray]]], names: list[str] | None = None
) -> DataFrame:
    """Every asked head on every row in one pass over Arrow batches: long (.., head_name, value,
    confidence)."""
    wanted = names or [*layers, *_CUSTOM_HEADS]
    custom = {n: _CUSTOM_HEADS[n] for n in wanted if n in _CUSTOM_HEADS}
    specs = [(n, HEADS[n], layers[n]) for n in wanted if n not in custom]

    @F.pandas_udf("array<double>")
    def score(v: pd.Series) -> pd.Series:
        """The values of all heads, then their confidences: one flat array per row."""
        x = _stack(v)
        columns = []
        for _, (activation, _, rule), mats in specs:
            y = x
            for i, (w, b) in enumerate(mats):
                y = ACTIVATIONS[activation if i == len(mats) - 1 else "relu"](y @ w.T + b)
            columns.append(_head_values(rule, y))
        columns += [head(x) for head in custom.values()]
        values, confidences = zip(*columns)
        return pd.Series(list(np.stack([*values, *confidences], axis=1).astype(np.float64)))

    names = [n for n, _, _ in specs] + list(custom)
    heads = F.array(
        *[
            F.struct(F.lit(n).alias("head_name"), F.get("_scores", F.lit(k)).alias("value"), F.get("_scores", F.lit(len(names) + k)).alias("confidence"))
            for k, n in enumerate(names)
        ]
    )
    keep = [c for c in rows.columns if c != vector]
    return rows.withColumn("_scores", score(F.col(vector))).select(*keep, F.inline(heads))


def best_prediction(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Highest confidence per key, the first one on ties."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("confidence", -F.col(index))).alias("r")
    )
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


# --- ranking ----------------------------------------------------------------------------------------------------


def hybrid_scores(rows: DataFrame, terms: list[str], k: int, tie: str, weights: tuple = (0.4, 0.25, 0.2, 0.15)) -> DataFrame:
    """Blend of four given terms, best k rows."""
    score = sum((F.col(t) * w for t, w in zip(terms, weights)), F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), tie).limit(k)
