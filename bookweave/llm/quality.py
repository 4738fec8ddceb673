"""Quality classifier: random Fourier features of document statistics, ridge scores from partition-summed normal
equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import bucket_of_id, slices, starts_of, stored, table, words_of

#: Byte classes whose shares are statistics; bytes of non-ASCII letters are class 5.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", None, b".,;:", b"!?", b"#$%&*@^~", b"|<>{}[]()=+/\\_"]
BINS = 512
THRESHOLD = 0.3


def byte_class() -> np.ndarray:
    of = np.full(256, len(CLASSES), np.int64)
    of[128:] = CLASSES.index(None)
    for k, chars in enumerate(CLASSES):
        of[list(chars or b"")] = k
    return of


def repeats(lists: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lists of strings: items, distinct items and the count of the most frequent item, per list."""
    owner, items = pc.list_parent_indices(lists).to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
    code = items.indices.to_numpy().astype(np.int64)
    key, times = np.unique(owner << 32 | code, return_counts=True)
    who = (key >> 32).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, who, times)
    return np.bincount(owner, minlength=n), np.bincount(who, minlength=n), top


def statistics(texts: pa.Array, of: np.ndarray) -> np.ndarray:
    """One row of statistics per text; an empty text has zeros."""
    n, k = len(texts), len(CLASSES) + 1
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    shares = np.bincount(np.repeat(np.arange(n) * k, size) + of[data], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    words, counts = words_of(texts)
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts_of(counts), len(words)).astype(np.int64)), words)
    n_words, n_distinct, top = repeats(lists, n)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(n), counts)
    mean = np.bincount(owner, length, minlength=n) / np.maximum(counts, 1)
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, minlength=n) / np.maximum(counts, 1) - mean**2, 0))
    n_lines, distinct_lines, top_line = repeats(pc.split_pattern(texts, "\n"), n)
    many = np.maximum(n_words, 1)
    return np.column_stack(
        [
            shares, np.log1p(size), np.log1p(n_words), mean, spread, n_distinct / many, n_distinct / np.sqrt(many), top / many,
            distinct_lines / np.maximum(n_lines, 1), top_line / np.maximum(n_lines, 1), np.log1p(size / np.maximum(n_lines, 1)),
        ]
    )


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    spin: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None
    edges: np.ndarray | None = None
    values: np.ndarray | None = None

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """cos features of the Gaussian kernel, after the standardised statistics themselves and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.spin + self.shift) * np.sqrt(2.0 / self.spin.shape[1])
        return np.column_stack([np.ones(len(x)), x, z])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0, 1)


def as_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(float)


def isotonic(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the increasing means closest to total / weight."""
    blocks: list[list[float]] = []
    for t, w in zip(total, weight):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    return np.concatenate([[t / w] * n for t, w, n in blocks]) if blocks else np.zeros(0)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, one row per row; null texts count as empty, texts are read whole."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches):
        of = byte_class()
        for batch in batches:
            for start, texts in slices(batch.column("text"), 2 << 20):
                values = statistics(texts, of)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), lists], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {id_type}, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, features: int = 192, width: float = 0.9, ridge: float = 1e-4) -> QualityModel | None:
    """Learn from every labelled row whose crc32(id) mod 5 is not 0; those with 4 calibrate, the others fit.

    Means and deviations come from all documents. Each task adds up Z'Z and Z'y of its rows, Spark sums the
    matrices row by row, the driver solves one system of fixed size. Calibration pools the mean label of 512
    score bins. None if no row with a label is there."""
    known = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y"))
    own = bucket_of_id(F.col("doc_id"), 5)
    train = stored(stats.join(known, "doc_id").withColumn("fold", own).where("fold <> 0"), "quality-labelled")
    first = train.select(F.size("stats")).first()
    if first is None:
        return None
    size = first[0]
    spread = stats.agg(*[f(F.get("stats", k)) for k in range(size) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(11)
    scale = np.maximum(np.array(spread[1::2], float), 1e-6)
    spin = rng.normal(0, 1 / (width * np.sqrt(size)), (size, features))
    model = QualityModel(np.array(spread[0::2], float), scale, spin, rng.uniform(0, 2 * np.pi, features), None)

    def equations(batches):
        total = 0
        for batch in batches:
            if len(batch):
                z = model.expand(as_matrix(batch.column("stats")))
                total = total + z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        if not np.isscalar(total):
            n, m = total.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists], names=["i", "sums"])

    fitting = train.where("fold <> 4")
    fitting = train if fitting.isEmpty() else fitting
    sums = fitting.select("stats", "y").mapInArrow(equations, "i bigint, sums array<double>")
    rows = sums.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).orderBy("i").collect()
    system = np.array([r["sums"] for r in rows])
    normal, target = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(normal + ridge * normal[0, 0] * np.eye(len(normal)), target)
    model = QualityModel(model.mean, model.scale, model.spin, model.shift, weights)

    def binned(batches):
        for batch in batches:
            if len(batch):
                place = np.clip((model.raw(as_matrix(batch.column("stats"))) + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("y")], names=["bin", "y"])

    aside = train.where("fold = 4")
    aside = train if aside.isEmpty() else aside
    bins = aside.select("stats", "y").mapInArrow(binned, "bin bigint, y double").groupBy("bin").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    bins = sorted(bins.collect())
    values = isotonic(np.array([b["t"] for b in bins]), np.array([b["n"] for b in bins], float))
    edges = (np.array([b["bin"] for b in bins]) + 0.5) * 2 / BINS - 0.5
    return QualityModel(model.mean, model.scale, model.spin, model.shift, weights, edges, values)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Only the text is an input of the score. Documents are read once; their statistics are stored and serve
    fitting and scoring. Without any usable label every score is 0.5. A null id is held out. Labels that
    repeat an id each count; labels without a document are not used; null labels are left out."""
    stats = stored(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            got = np.full(len(batch), 0.5) if model is None or not len(batch) else model.score(as_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    held_out = F.coalesce(bucket_of_id(F.col("doc_id"), 5) == 0, F.lit(True))
    scored = stats.mapInArrow(score, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
