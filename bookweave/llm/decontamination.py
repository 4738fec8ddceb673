"""Benchmark decontamination by spaced seeds: fixed masks ignore chosen word positions, so that a passage with
substituted words still shares hashes with the benchmark; overlaps around hits are verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import stored, table

#: Fixed masks: 1 takes a word of the window, 0 ignores it. For any two substitutions in 10 to 13 words, and any one in
#: 9, some mask lies somewhere in those words so that it ignores both.
MASKS = ("1110111", "111010011", "10011111", "1101001011", "1111101")
SPAN = max(len(m) for m in MASKS)
#: Items of so many words are also hashed as a whole; shorter ones are too short to tell from chance.
SHORT = range(5, 9)
#: An overlap counts if in some window of this many aligned words (the whole item if it is shorter) at least
#: this share of words is equal.
WINDOW, SHARE = 13, 0.8
#: Benchmark seeds (16 bytes each) are broadcast up to this many; more are joined by shuffle.
SMALL_SEEDS = 2_000_000


def word_codes(text: Column) -> Column:
    """64-bit hash of each run of letters and digits, in lower case."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def seeds(rows: DataFrame, ids: list[str], whole: list[int], items: bool = False) -> DataFrame:
    """(ids, pos, seed): the hashes under every mask of every window of ``codes``, and of every run of as many
    words as a length in ``whole`` says (of an item only if it has just that many). A text shorter than a mask has
    none for it."""
    windows = rows.select(
        *ids, "codes", F.posexplode(F.arrays_zip(*[F.expr(f"slice(codes, {k + 1}, size(codes))").alias(f"w{k}") for k in range(SPAN)]))
    )
    hashes = []
    for number, mask in enumerate(MASKS):
        taken = [F.col(f"col.w{k}") for k, bit in enumerate(mask) if bit == "1"]
        fits = F.col("pos") + len(mask) <= F.size("codes")
        hashes.append(F.when(fits, F.xxhash64(F.lit(number), *taken)))
    for n in whole:
        fits = F.size("codes") == n if items else F.col("pos") + n <= F.size("codes")
        hashes.append(F.when(fits & (F.lit(not items) | (F.col("pos") == 0)), F.xxhash64(F.lit(-n), *[F.col(f"col.w{k}") for k in range(n)])))
    return windows.select(*ids, "codes", "pos", F.explode(F.array(*hashes)).alias("seed")).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per (doc_id, item_id) that overlap: where it starts in both (in words), how many words are
    aligned and how many of them are equal.

    Every window of every text and item is hashed under each mask; the hashes are joined. A hit puts item and
    text on a diagonal (difference of positions); all words of the item that lie on it are compared, and the
    pair counts if a window of ``window`` words (or the whole item) has ``share`` of them equal. Of several
    diagonals the one with the most equal words is given, then the first.

    The item's seeds are broadcast if they are counted to be few; else the join shuffles both sides by seed,
    where Spark splits a frequent one. A hit carries only the words under the item, so nothing else of a text
    is moved. With the fixed masks no overlap of an item of 9 words or more is missed. Items of 5 to 8 words are
    found where all their words stand in a row (and some of those with a substitution); shorter ones are too
    short to tell from chance and match nothing. Null ids, null and empty texts match nothing. Repeated rows give
    one row; empty tables give an empty result; other columns are not read."""
    items = stored(
        benchmark.where("item_id IS NOT NULL").select("item_id", word_codes(F.col("text")).alias("codes")).distinct(), "benchmark-codes"
    )
    lengths = items.where(F.size("codes").between(SHORT[0], SHORT[-1])).select(F.size("codes").alias("n")).distinct()
    whole = sorted(r["n"] for r in lengths.collect())
    item_seeds = seeds(items, ["item_id"], whole, items=True).select("item_id", F.col("pos").alias("item_pos"), "seed", F.size("codes").alias("item_words"))
    item_seeds = stored(item_seeds.distinct(), "benchmark-seeds")
    few = item_seeds.limit(SMALL_SEEDS + 1).count() <= SMALL_SEEDS
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", word_codes(F.col("text")).alias("codes"))
    hits = seeds(texts, ["doc_id"], whole).join(F.broadcast(item_seeds) if few else item_seeds, "seed")
    shift = F.col("pos") - F.col("item_pos")
    begin = F.greatest(shift, F.lit(0))
    words = F.slice(F.col("codes"), begin + 1, F.col("item_words") + F.least(shift, F.lit(0)))
    found = hits.select("doc_id", "item_id", shift.alias("shift"), "item_words", words.alias("words")).distinct()
    pairs = found.join(items, "item_id").where(F.size("codes") == F.col("item_words"))
    skip = F.greatest(-F.col("shift"), F.lit(0))
    under = F.slice(F.col("codes"), skip + 1, F.size("words"))
    pairs = pairs.withColumn("equal", F.zip_with("words", under, lambda a, b: (a == b).cast("int")))
    aligned, need = F.size("words"), F.least(F.lit(window), F.col("item_words"))
    sums = F.aggregate(
        "equal",
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    pairs = pairs.withColumn("sums", sums).where((aligned >= need) & (F.col("item_words") >= SHORT[0]))
    best = F.array_max(F.transform(F.sequence(F.lit(0), aligned - need), lambda k: F.get("sums", k + need) - F.get("sums", k)))
    pairs = pairs.withColumn("best", best).where(F.col("best") >= F.ceil(need * F.lit(share)))
    matched = F.element_at("sums", -1)
    chosen = pairs.groupBy("doc_id", "item_id").agg(
        F.max(
            F.struct(
                matched.alias("matched_words"),
                (-F.col("shift")).alias("order"),
                F.greatest("shift", F.lit(0)).alias("doc_start"),
                skip.alias("item_start"),
                aligned.alias("aligned_words"),
                F.col("item_words"),
            )
        ).alias("x")
    )
    return chosen.select("doc_id", "item_id", "x.doc_start", "x.item_start", "x.aligned_words", "x.matched_words", "x.item_words")


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap with the benchmark, with all their columns."""
    found = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
