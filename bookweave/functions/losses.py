"""Losses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def huber(predicted: Column, target: Column, delta: float = 1.0) -> Column:
    e = F.abs(predicted - target)
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))


def binary_cross_entropy(predicted: Column, target: Column) -> Column:
    p = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), predicted))
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))


def cross_entropy(probabilities: Column, target_class: Column) -> Column:
    return -F.log(F.greatest(F.lit(1e-7), F.get(probabilities, target_class)))


def quantile(predicted: Column, target: Column, tau: float) -> Column:
    e = target - predicted
    return F.when(e >= 0, tau * e).otherwise((tau - 1) * e)


HEADS = ["mid_price", "fill_prob", "cancel_prob", "slippage", "vol_jump", "regime_transition"]


def composite(lambda_fill: float = 1.0, lambda_risk: float = 2.0, probabilities: str | None = None) -> dict[str, Column]:
    """Loss per head from prediction columns named like the heads and the label columns; a head without
    a prediction gives null, and ``total`` skips it."""
    flag = lambda name: F.col(name).cast("double")
    if probabilities:
        regime = cross_entropy(F.col(probabilities), F.col("regime_label"))
    else:
        regime = F.when(F.col("regime_transition") == F.col("regime_label"), F.lit(0.0)).when(
            F.col("regime_transition").isNotNull(), F.lit(1.0)
        )
    losses = {
        "mid_price": huber(F.col("mid_price"), F.col("mid_price_move_bp")),
        "fill_prob": binary_cross_entropy(F.col("fill_prob"), flag("fill_occurred")) * lambda_fill,
        "cancel_prob": binary_cross_entropy(F.col("cancel_prob"), flag("cancel_occurred")) * lambda_fill,
        "slippage": quantile(F.col("slippage"), F.col("slippage_bp"), 0.75) * lambda_risk,
        "vol_jump": binary_cross_entropy(F.col("vol_jump_prob"), flag("vol_jump")) * lambda_risk,
        "regime_transition": regime,
    }
    total = F.lit(0.0)
    for loss in losses.values():
        total = total + F.coalesce(loss, F.lit(0.0))
    return {**losses, "total": total}
