"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes in the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import SPACE, stored, table


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(docs: DataFrame, hash_digits: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the first 128 bits of the SHA-256 of the normalised text. The same aggregate keeps
    the smallest and the largest text of each hash, combined on the map side, so that even a group with a
    third of all rows reaches its reducer as one row per task; the two texts are equal exactly if all texts
    of the group are. Groups in which they differ (collisions) are grouped again by hash and text. Then the
    narrow (hash, id) rows are joined to their groups; Spark splits a hot hash there.

    Nulls: a null text is an empty text; a null id is never the smallest id and its row is not kept unless
    all ids of the group are null. Rows that repeat an id and its text are the same document, so each of them
    is marked kept if that id is. An empty table gives an empty result; other columns are not read.
    ``hash_digits`` shortens the hash in tests, to force collisions."""
    text = normalised(F.col("text"))
    sha = F.sha2(text.cast("binary"), 256)
    rows = docs.select("doc_id", text.alias("norm")).select("doc_id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    hashed = rows.withColumn("h", F.substring("text_sha256", 1, hash_digits))
    groups = stored(
        hashed.groupBy("h")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("norm").alias("low"), F.max("norm").alias("high"))
        .select("h", "keep_id", "group_size", (F.col("low") == F.col("high")).alias("same")),
        "exact-groups",
    )
    narrow = docs.select("doc_id", sha.alias("text_sha256")).withColumn("h", F.substring("text_sha256", 1, hash_digits))
    found = narrow.join(groups.where("same").drop("same"), "h")
    clashes = groups.where("not same").select("h")
    if not clashes.isEmpty():
        inside = hashed.join(clashes, "h", "left_semi")
        apart = inside.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(inside.join(apart, ["h", "norm"]).drop("norm"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat an id and its text, one stays."""
    ids = exact_duplicates(docs).where("kept").select("doc_id", "text_sha256").distinct()
    own = docs.withColumn("_sha", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    kept = own.join(
        ids.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha2")),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_sha2")),
        "left_semi",
    )
    repeated = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    return kept.dropDuplicates(["doc_id", "_sha"]).select(docs.columns)


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
