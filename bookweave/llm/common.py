"""What several operators of this folder share: tables, shared storage, word and hash helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it.
SPACE = r"[\x20\x09-\x0D]+"
#: Texts are worked on in slices of about this many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 8 << 20
#: What a batch holds between Spark and Python ``in_small_batches``: rows, and bytes where rows are long.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without the setting gets a folder
    of its own; a cluster without it is refused."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="bookweave-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: columnar, pruned by column, and independent of
    the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(operator: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """While the operator runs, its tasks hand over small batches: the executor and each Python worker hold a few
    of them beside the Java heap. Afterwards the session's own limits hold again, so this is for operators that
    leave no Python work to the table they return."""

    @wraps(operator)
    def run(docs: DataFrame) -> DataFrame:
        conf = docs.sparkSession.conf
        limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
        before = {key: conf.get(key, None) for key in limits}
        try:
            for key, most in limits.items():
                conf.set(key, str(most))
            return operator(docs)
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)

    return run


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, texts) pieces of about ``limit`` bytes; nulls become empty texts. One text is never split."""
    texts = texts.cast(pa.large_string()).fill_null("")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield start, texts.slice(start, end - start)
        start = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words between ASCII white space, of all texts in a row, and words per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(words, "")
    return words.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))[:-1]


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of undirected links (a, b): (node, component), the smallest node of each.

    Alternates large-star and small-star steps, as joins on the smallest neighbour, until the links do
    not change. Nodes without a link do not appear."""
    edges = stored(links.where("a <> b").select("a", "b").distinct(), label)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = now
