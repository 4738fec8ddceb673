"""Vector columns (ARRAY<DOUBLE>): element-wise maths, reductions and activations in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_scale(a: Column, factor: Column | float) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(factor)
    return F.transform(a, lambda x: x * f)


def vec_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def vec_dot(a: Column, b: Column) -> Column:
    return vec_sum(F.zip_with(a, b, lambda x, y: x * y))


def vec_norm(a: Column) -> Column:
    return F.sqrt(vec_dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b))


def vec_concat(*parts: Column) -> Column:
    return F.concat(*parts)


def vec_slice(a: Column, start: int, length: int) -> Column:
    """``length`` elements from the 0-based ``start``."""
    return F.slice(a, start + 1, length)


def pad_or_cut(a: Column, size: int) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.when(x > 20, x).otherwise(F.log1p(F.exp(x)))


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    exps = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / vec_sum(exps))


def arg_max(v: Column) -> Column:
    """0-based place of the largest element, the lowest place on ties."""
    return F.array_position(v, F.array_max(v)) - 1


# Confidences of model heads.
def mid_confidence(m: Column) -> Column:
    return F.abs(m) / (F.abs(m) + 1)


def probability_confidence(p: Column) -> Column:
    return F.abs(2 * p - 1)


def slippage_confidence(s: Column) -> Column:
    return 1 / (1 + s)


def class_confidence(p: Column, n: int) -> Column:
    return F.greatest(F.lit(0.0), (p - 1 / n) / (1 - 1 / n))


def size_confidence(p: Column) -> Column:
    return 1 - 2 * F.abs(p - 0.5)
