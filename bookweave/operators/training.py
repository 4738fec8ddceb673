"""Training of the heads on label windows with Spark ML, and the evaluation losses."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.losses import HEADS, composite


def clip_to_norm(gradient: np.ndarray, limit: float = 1.0) -> np.ndarray:
    norm = float(np.linalg.norm(gradient))
    return gradient * (limit / norm) if norm > limit else gradient


def fit_quantile(
    rows: DataFrame, features: list[str], target: str, tau: float = 0.75, steps: int = 20, rate: float = 0.5
) -> np.ndarray:
    """Linear quantile head by distributed sub-gradient steps: each step is one aggregate that brings
    back one number per feature, clipped to norm 1. The last weight is the intercept."""
    w = np.zeros(len(features) + 1)
    for step in range(steps):
        predicted = linear(features, w)
        slope = F.when(F.col(target) >= predicted, F.lit(-tau)).otherwise(F.lit(1 - tau))
        sums = rows.agg(*[F.avg(slope * F.col(f)).alias(f) for f in features], F.avg(slope).alias("_b")).first()
        gradient = np.array([float(x or 0.0) for x in sums])
        w = w - rate / (1 + step) ** 0.5 * clip_to_norm(gradient)
    return w


def linear(features: list[str], w: np.ndarray) -> Column:
    total = F.lit(float(w[-1]))
    for f, x in zip(features, w):
        total = total + F.col(f) * float(x)
    return total


def train_heads(train: DataFrame, features: list[str]) -> dict:
    """One model per head: Huber regression, three logistic heads, a softmax regime head and the
    quantile head. Features are assembled once and cached for the passes over them."""
    data = VectorAssembler(inputCols=features, outputCol="features").transform(train).withColumns(
        {c: F.col(c).cast("double") for c in ("fill_occurred", "cancel_occurred", "vol_jump", "regime_label")}
    ).persist()
    logistic = lambda label, family="binomial": LogisticRegression(
        labelCol=label, maxIter=20, regParam=1e-3, family=family
    ).fit(data)
    models = {
        "mid_price": LinearRegression(labelCol="mid_price_move_bp", loss="huber", maxIter=20, regParam=1e-3).fit(data),
        "fill_prob": logistic("fill_occurred"),
        "cancel_prob": logistic("cancel_occurred"),
        "vol_jump": logistic("vol_jump"),
        "regime_transition": logistic("regime_label", "multinomial"),
        "slippage": fit_quantile(data, features, "slippage_bp"),
    }
    data.unpersist()
    return models


def predict_heads(rows: DataFrame, models: dict, features: list[str]) -> DataFrame:
    """Prediction columns named like the heads, next to the labels."""
    out = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    from pyspark.ml.functions import vector_to_array

    for name, model in models.items():
        column = "vol_jump_prob" if name == "vol_jump" else name
        if isinstance(model, np.ndarray):
            out = out.withColumn(column, linear(features, model))
            continue
        scored = model.transform(out)
        if name == "mid_price":
            value = F.col("prediction")
        elif name == "regime_transition":
            value = vector_to_array("probability")
        else:
            value = vector_to_array("probability")[1]
        extra = [c for c in scored.columns if c not in out.columns]
        target = "regime_probs" if name == "regime_transition" else column
        out = scored.withColumn(target, value).drop(*[c for c in extra if c != target])
    return out.drop("features")


def loss_means(rows: DataFrame, probabilities: str | None = None, **lambdas: float) -> DataFrame:
    """Mean total loss and mean loss per head over windows, as long rows."""
    losses = composite(probabilities=probabilities, **lambdas)
    parts = [F.struct(F.lit(n).alias("head"), F.avg(losses[n]).alias("loss")) for n in [*HEADS, "total"]]
    return rows.agg(F.array(*parts).alias("l")).select(F.inline("l"))
