"""Secret scan with corpus-wide ownership frequency: copied examples apart from one owner's live-looking values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import stored, table

#: Fixed patterns. Each scans left to right without overlaps; matches too short by MINIMUM are dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the method adds to the fixed kinds: long runs that mix upper case, lower case and digits.
MIXED = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "mixed"]
#: A value of more owners than this is a copied example.
MAX_OWNERS = 2


def spans(text: Column, kind: str, pattern: str, value: int, least: int) -> Column:
    """Matches of a pattern as (start, rank, end, kind, value), in code points. The gaps between the matches
    give their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def place(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.concat(done["out"], F.when(F.length(x["v"]) >= least, one).otherwise(empty)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), place, lambda done: done["out"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text), all candidates in each whole text, base ones marked by their kind.

    The costly expressions run only where a cheap test finds that the pattern may match."""
    text = F.col("text")
    low = F.lower(text)
    words = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "api"):
        words = words | low.contains(word)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    mixed = F.filter(
        spans(text, "mixed", MIXED, 0, 24),
        lambda x: x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]"),
    )
    parts = [
        F.when(words, spans(text, "assign", ASSIGN, 2, 8)),
        F.when(text.contains("AKIA"), spans(text, "access", ACCESS, 0, 16)),
        F.when(text.rlike(HEX), spans(text, "hex", HEX, 0, 32)),
        F.when(text.rlike(MIXED), mixed),
    ]
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("row"), F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts])).alias("found"))
    hashed = F.transform(
        "found",
        lambda x: F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"),
            F.substring(F.sha2(x["value"].cast("binary"), 256), 1, 32).alias("value_hash"), live_looking(x["value"]).alias("lively")
        ),
    )
    return found.select("doc_id", "source", "row", hashed.alias("found"))


def live_looking(value: Column) -> Column:
    """Letters and digits, and many different characters: not a word or a placeholder."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value hash: in how many distinct repositories (documents) and of how many distinct owners (sources)
    it occurs. Each step sums on the map side first, so a value of a third of all rows is one row per task."""
    once = candidates.groupBy("value_hash", "source", "doc_id").agg(F.count("*").alias("n"))
    by_owner = once.groupBy("value_hash", "source").agg(F.count("doc_id").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.sum("repositories").alias("n_repositories"), F.count("source").alias("n_owners"), F.sum("n").alias("n_occurrences"))


def classified(candidates: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Candidates with their counts and class: ``example`` for a value of more than ``max_owners`` owners,
    else ``live`` if it looks like a generated one, else ``weak``. The counts of a frequent value join narrow
    rows, which Spark splits where they are skewed."""
    kind = F.when(F.col("n_owners") > max_owners, "example").when(F.col("lively"), "live").otherwise("weak")
    return candidates.join(ownership(candidates), "value_hash").withColumn("class", kind)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    The fixed kinds always stay in ``spans``. A mixed run is added if its value belongs to few owners and
    looks live, and no fixed span overlaps it. n_live and n_example count a document's spans by the class of
    their value. Null text is empty, and gives zeros and empty strings. A null source or id is no owner or
    repository. Repeated rows give repeated results; an empty table an empty one; other columns are not read."""
    rows = stored(scanned(docs), "secret-candidates")
    base = F.filter("found", lambda x: x["kind"] != "mixed")
    candidates = rows.where(F.size("found") > 0).select("doc_id", "source", "row", F.explode("found").alias("x")).select("doc_id", "source", "row", "x.*")
    verdicts = classified(candidates, max_owners)
    by_row = verdicts.groupBy("row").agg(
        F.collect_set(F.when((F.col("kind") == "mixed") & (F.col("class") == "live"), F.struct("start", "rank", "end", "kind"))).alias("added"),
        F.count_distinct(F.when(F.col("class") == "live", F.struct("start", "rank"))).alias("n_live"),
        F.count_distinct(F.when(F.col("class") == "example", F.struct("start", "rank"))).alias("n_example"),
    )
    own = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    out = rows.select("doc_id", "row", own.alias("base")).join(by_row, "row", "left")
    extra = F.filter(
        F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")),
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(table(spark, folder, "documents"))
