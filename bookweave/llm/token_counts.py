"""Token counts: additive totals by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import shared_folder, slices, stored, table
from bookweave.llm.exact_dedup import normalised
from bookweave.llm.packing import VOCABULARY, encoder

#: The vocabulary that counts texts in other languages than English anew.
MANY_LANGUAGES = "byte_bpe_multi_50k.tiktoken"
GROUP = ["source", "lang", "tokenizer_version"]
ROW = "doc_id bigint, source string, lang string, tokenizer_version string, tokens bigint"


class TokenRollup:
    """Totals as the sum of signed deltas, one folder of deltas per batch.

    ``commit(batch, changes)`` takes rows (doc_id, source, lang, tokenizer_version, tokens, deleted): an insert
    or a revised count of a document, or its deletion (only doc_id is read then). The rows that held before
    the batch are looked up, so a revision takes back the old count where it stood and adds the new one, also
    when source, language or version changed. A batch writes its folders anew: to commit it again, after a
    failure or by mistake, changes nothing. Batches are numbered in order; a batch looks only at earlier ones.

    If a batch has several rows for a document, a deletion wins, then the largest row. A deletion of an
    unknown document does nothing. Rows with a null id are inserted, but can't be revised or deleted. Null
    source, language and version are groups of their own; null tokens count as 0."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.batches: list[int] = []

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def standing(self, before: int) -> DataFrame:
        """The row of each document that holds after all batches before this one."""
        rows = self._read("rows", [b for b in self.batches if b < before], f"{ROW}, deleted boolean, batch bigint")
        last = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("batch", "deleted", *GROUP, "tokens")).alias("x"))
        return last.where("NOT x.deleted").select("doc_id", *[f"x.{c}" for c in GROUP], "x.tokens")

    def commit(self, batch: int, changes: DataFrame) -> None:
        rows = changes.select("doc_id", *GROUP, F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
        known = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("deleted", *GROUP, "tokens")).alias("x"))
        known = known.select("doc_id", *[f"x.{c}" for c in GROUP], "x.tokens", "x.deleted")
        rows = known.unionByName(rows.where("doc_id IS NULL AND NOT deleted"))
        rows.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        now = self._read("rows", [batch], f"{ROW}, deleted boolean, batch bigint")
        old = self.standing(batch).join(now.select("doc_id"), "doc_id", "left_semi")
        plus = now.where("NOT deleted").select(*GROUP, F.lit(1).alias("documents"), "tokens")
        minus = old.select(*GROUP, F.lit(-1).alias("documents"), (-F.col("tokens")).alias("tokens"))
        sums = plus.unionByName(minus).groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.where("documents <> 0 OR tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        if batch not in self.batches:
            self.batches.append(batch)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, documents, tokens; groups without a document are left out."""
        deltas = self._read("deltas", self.batches, "source string, lang string, tokenizer_version string, documents bigint, tokens bigint")
        return deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")


def counted(docs: DataFrame, recount: str = "lang <> 'en'") -> DataFrame:
    """Documents with their tokens under the two vocabularies (the second only where ``recount`` holds) and
    the hash of their text. Null texts have no tokens."""
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_hash"), F.coalesce(F.expr(recount), F.lit(False)).alias("again"), "text",
    )

    def count(batches):
        first, second = encoder(VOCABULARY), encoder(MANY_LANGUAGES)
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                own = batch.slice(start, len(texts))
                raw, again = texts.to_pylist(), own.column("again").to_pylist()
                n1 = [len(first.encode_to_numpy(t, disallowed_special=())) for t in raw]
                n2 = [len(second.encode_to_numpy(t, disallowed_special=())) if a else None for t, a in zip(raw, again)]
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in ("doc_id", "source", "lang", "text_hash")], pa.array(n1, pa.int64()), pa.array(n2, pa.int64())],
                    names=["doc_id", "source", "lang", "text_hash", "tokens", "tokens_again"],
                )

    return rows.mapInArrow(count, "doc_id bigint, source string, lang string, text_hash string, tokens bigint, tokens_again bigint")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches over all documents: insert them all; delete those whose text (but for white space) a
    smaller id has too; count the others anew, with the vocabulary for many languages, unless they are English."""
    rows = stored(counted(table(spark, folder, "documents")), "token-counts")
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    version = F.lit(VOCABULARY).alias("tokenizer_version")
    rollup.commit(1, rows.select("doc_id", "source", "lang", version, "tokens", F.lit(False).alias("deleted")))
    least = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least"))
    copies = rows.join(least, "text_hash").where("doc_id > least").select("doc_id", "source", "lang", version, "tokens", F.lit(True).alias("deleted"))
    rollup.commit(2, copies)
    anew = rows.where("tokens_again IS NOT NULL").join(rollup.standing(3).select("doc_id"), "doc_id", "left_semi")
    rollup.commit(3, anew.select("doc_id", "source", "lang", F.lit(MANY_LANGUAGES).alias("tokenizer_version"), F.col("tokens_again").alias("tokens"), F.lit(False).alias("deleted")))
    return rollup.totals()
