"""Top-k per key and latest-per-key without collecting a key's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_per_key(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of every key in ``order``. ``row_number <= limit`` makes Spark place a
    window group limit below the shuffle, so at most ``limit`` rows per key and task travel."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of every key, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col("row")[c].alias(c) for c in rest])
