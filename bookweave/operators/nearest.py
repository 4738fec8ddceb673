"""Nearest vectors by cosine distance: exact, and by locality-sensitive hashing of unit vectors.

Both deal corpus and queries out to parts, send each part its queries first and then stream its corpus rows past
them. A task holds the queries of one part and their best k, never the corpus, and sends on k rows per query.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.operators.topk import newest_per_key
from bookweave.session import checkpoint_dir

#: Queries that pass the corpus together, and corpus rows of one part, about.
WAVE_QUERIES, PART_ROWS = 16_384, 100_000
#: Hash tables of the approximate search, and corpus rows that one bucket should hold, about.
TABLES, BUCKET_ROWS = 16, 500


def _stored(df: DataFrame, label: str, mode: str = "errorifexists", folder: str | None = None) -> DataFrame:
    spark = df.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode(mode).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, h as doubles) of the rows that have a direction: null, empty and zero vectors have none."""
    h = F.col(vector).cast("array<double>")
    length = F.aggregate(h, F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(key, h.alias("h"), length.alias("_length")).where("_length > 0").drop("_length")


def best_in_parts(corpus: DataFrame, queries: DataFrame, parts: list[str], k: int) -> DataFrame:
    """(query_id, id, distance): for each query (parts, query_id, h) the best k rows (parts, id, h) of each part
    it is in, ties by id."""
    query_type, id_type = queries.schema["query_id"].dataType, corpus.schema["id"].dataType
    left = corpus.select(*parts, F.lit(True).alias("row"), "id", F.lit(None).cast(query_type).alias("query_id"), "h")
    right = queries.select(*parts, F.lit(False).alias("row"), F.lit(None).cast(id_type).alias("id"), "query_id", "h")
    dealt = left.unionByName(right).repartition(*parts).sortWithinPartitions(*parts, "row")

    def search(batches) -> Iterator[pd.DataFrame]:
        asked: list[pd.DataFrame] = []
        unit, best, current = None, None, None

        def closed():
            return best[["query_id", "id", "distance"]] if best is not None and len(best) else None

        for batch in batches:
            for part, rows in batch.groupby(parts, sort=False, dropna=False):
                if part != current:
                    if (out := closed()) is not None:
                        yield out
                    asked, unit, best, current = [], None, None, part
                is_row = rows["row"].to_numpy(dtype=bool)
                if (~is_row).any():
                    asked.append(rows.loc[~is_row, ["query_id", "h"]])
                found = rows[is_row]
                if not asked or not len(found):
                    continue
                if unit is None:
                    names = pd.concat(asked)["query_id"].to_numpy()
                    unit = np.array(pd.concat(asked)["h"].tolist(), dtype=np.float64)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                x = np.array(found["h"].tolist(), dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                new = [best] if best is not None else []
                ids = found["id"].to_numpy()
                for a in range(0, len(unit), 1024):
                    distance = 1 - unit[a : a + 1024] @ x.T
                    # all rows at most as far as the k-th, ties included
                    bound = np.partition(distance, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                    q, r = np.nonzero(distance <= bound[:, None])
                    new.append(pd.DataFrame({"query": q + a, "query_id": names[q + a], "id": ids[r], "distance": distance[q, r]}))
                best = pd.concat(new).sort_values(["query", "distance", "id"]).groupby("query", sort=False).head(k)
        if (out := closed()) is not None:
            yield out

    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, distance double"
    return dealt.mapInPandas(search, schema)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, wave: int = WAVE_QUERIES, part_rows: int = PART_ROWS) -> DataFrame:
    """Exact top-k by cosine distance for each query (query_id, q) over (id, h): query_id, id, distance, rank.

    Queries pass the corpus in waves of bounded size, which Spark sends to each part of the corpus; the result of
    a wave is written before the next one starts. No vector passes the driver. Rows and queries without a
    direction have no distance and give no rows; of equal distances the smaller id comes first."""
    spark = corpus.sparkSession
    corpus = _usable(corpus, "id", "h")
    asked = _usable(queries, "query_id", "q")
    waves = max(1, math.ceil(asked.count() / wave))
    parts = max(1, math.ceil(corpus.count() / part_rows))
    numbered = asked.withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(waves)))
    numbered = _stored(numbered.repartitionByRange("wave"), "nearest-queries") if waves > 1 else numbered
    placed = corpus.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    folder, found = f"{checkpoint_dir(spark)}/nearest-{uuid.uuid4().hex}", None
    for number in range(waves):
        sent = numbered.where(F.col("wave") == number).select("query_id", "h", every.alias("part"))
        best = best_in_parts(placed, sent, ["part"], k)
        if waves > 1:
            best = _stored(_ranked(best, k), "nearest", "append", folder)
        found = best
    return found if waves > 1 else _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return newest_per_key(found, ["query_id"], [F.col("distance"), F.col("id")], k)


def signatures(h: Column, tables: int, bits: int, seed: int = 7) -> Column:
    """Per table (bucket, margins): on which side of ``bits`` random planes a vector lies, and how far from each."""
    powers = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf("array<struct<bucket: bigint, margins: array<float>>>")
    def of(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), dtype=np.float64)
        planes = np.random.default_rng(seed).standard_normal((tables * bits, x.shape[1]))
        side = (x @ planes.T).reshape(len(x), tables, bits)
        bucket = (side > 0) @ powers
        near = np.abs(side).astype(np.float32)
        return pd.Series([[{"bucket": int(b), "margins": m.tolist()} for b, m in zip(bucket[i], near[i])] for i in range(len(x))])

    return of(h)


def nearest_lsh(
    corpus: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, probes: int | None = None, bits: int | None = None,
    bucket_rows: int = BUCKET_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Approximate top-k by cosine distance: as ``nearest``, among the rows that share a bucket with the query.

    The sides of random planes put every row into one bucket per table. The number of planes follows from the
    number of rows, so that a bucket holds about ``bucket_rows`` of evenly spread vectors. A query looks into its own
    bucket and those behind its nearest planes (``probes`` of them, by default all that are one plane away).
    Buckets of very many rows, as copies make them, are cut into parts, and the queries go to each."""
    corpus, asked = _usable(corpus, "id", "h"), _usable(queries, "query_id", "q")
    bits = bits or max(1, round(math.log2(max(2.0, corpus.count() / bucket_rows))))
    probes = bits if probes is None else min(probes, bits)
    hashed = F.posexplode(signatures(F.col("h"), tables, bits)).alias("table", "s")
    placed = corpus.select("id", "h", hashed).select("id", "h", "table", F.col("s.bucket").alias("bucket"))
    placed = _stored(placed, "nearest-buckets")
    planes = F.transform("s.margins", lambda m, i: F.struct(m.alias("margin"), i.alias("plane")))
    behind = F.transform(F.slice(F.array_sort(planes), 1, probes), lambda p: p["plane"])
    looked = asked.select("query_id", "h", hashed).select("query_id", "h", "table", "s.bucket", F.explode(F.concat(F.array(F.lit(-1)), behind)).alias("plane"))
    flipped = F.when(F.col("plane") < 0, F.col("bucket")).otherwise(F.col("bucket").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("plane"))))
    looked = looked.select("query_id", "h", "table", flipped.alias("bucket"))
    crowded = placed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).where("parts > 1")
    cut = lambda rows: rows.join(crowded, ["table", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = cut(placed).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    sent = cut(looked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = best_in_parts(rows, sent, ["table", "bucket", "part"], k)
    return _ranked(found.groupBy("query_id", "id").agg(F.min("distance").alias("distance")), k)
