"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response, validator checks,
and the merge of the headers that a 304 answer may update."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import stored, table

#: Fixed list: fields that describe the body or the connection, which a 304 answer does not update.
KEPT_FROM_RESPONSE = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "etag", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slashes, query parameters in
    order without utm_ ones; scheme and fragment are dropped. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(F.regexp_replace(bare, "^[^/?]*", ""), "^[^?]*", 0), "/+$", "")
    query = F.split(F.regexp_replace(bare, r"^[^?]*[?]?", ""), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).startswith("utm_")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """Entries with lower-case names; of names that differ in case only, the first stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those of the revisit that it may update in their place."""
    old = F.coalesce(lower_keys(response), F.array().cast("array<struct<key:string,value:string>>"))
    new = F.filter(F.coalesce(lower_keys(revisit), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~e["key"].isin(KEPT_FROM_RESPONSE))
    names = F.transform(new, lambda e: e["key"])
    return F.map_from_entries(F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["key"])), new))


def latest_responses(records: DataFrame) -> DataFrame:
    """(record_id, response_id) of each revisit with an earlier full response of its canonical URL.

    The narrow rows are range-partitioned and sorted by (canonical, ts, record_id), so a URL with a third of
    all rows spreads over many tasks. Each task carries the latest response forward; what it hands to the next
    tasks is one row (its first and last URL and the last response), and these rows, one per partition, are
    chained on the driver and joined back to the rows that found nothing in their own task."""
    rows = records.where("canonical IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL")
    rows = rows.select("canonical", "ts", "record_id", (F.col("kind") == "response").alias("full"))
    width = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, "canonical", "ts", "record_id").sortWithinPartitions("canonical", "ts", "record_id")

    def carry(batches):
        part, url, response, first = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            out = []
            for canonical, record, full in zip(*(batch.column(c).to_pylist() for c in ("canonical", "record_id", "full"))):
                if canonical != url:
                    url, response = canonical, None
                first = url if first is None else first
                if full:
                    response = record
                else:
                    out.append((part, canonical, record, response, canonical == first and response is None))
            yield pa.RecordBatch.from_pydict(
                {k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate([("part", pa.int64()), ("url", pa.string()), ("record_id", pa.int64()), ("response_id", pa.int64()), ("open", pa.bool_())])}
            )
        if first is not None:  # the summary of this task has no record
            yield pa.RecordBatch.from_pydict({"part": [part], "url": pa.array([url]), "record_id": pa.array([None], pa.int64()), "response_id": pa.array([response], pa.int64()), "open": pa.array([first == url])})

    found = stored(ranged.mapInArrow(carry, "part bigint, url string, record_id bigint, response_id bigint, open boolean"), "warc-found")
    last, handed = (None, None), []
    for row in sorted(found.where("record_id IS NULL").collect(), key=lambda r: r["part"]):
        handed.append((row["part"], *last))
        if row["response_id"] is not None or not row["open"] or row["url"] != last[0]:
            last = (row["url"], row["response_id"])
    before = records.sparkSession.createDataFrame(handed, "part bigint, url string, handed bigint").where("handed IS NOT NULL")
    own = found.where("record_id IS NOT NULL").join(before, ["part", "url"], "left")
    response = F.coalesce("response_id", F.when(F.col("open"), F.col("handed")))
    return own.select("record_id", response.alias("response_id")).where("response_id IS NOT NULL")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the full response it stands for: record_id, url, ts, response_id, outcome, status,
    headers, body.

    ``records`` has record_id (unique), url, ts, kind (response or revisit), status, headers (a map) and body.
    The latest earlier response of the same canonical URL is taken, by (ts, record_id). It is checked by
    the strongest validator that the revisit has: ETag (W/ is ignored), else Last-Modified, else neither. The
    outcome is ``resolved``; ``mismatch`` if the validator differs or the response lacks it; or ``missing``
    without an earlier response. Only resolved rows get status, merged headers and body. Revisits with a null
    url, ts or id are missing; null headers are empty. Records of other kinds are left out."""
    base = records.select("record_id", "url", "ts", "kind", "status", "headers", "body").withColumn("canonical", canonical_url(F.col("url")))
    base = base.where("kind IN ('response', 'revisit')")
    pairs = latest_responses(base)
    revisits = base.where("kind = 'revisit'").select("record_id", "url", "ts", F.col("headers").alias("new")).join(pairs, "record_id", "left")
    full = base.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "status", F.col("headers").alias("old"), "body")
    both = revisits.join(full, "response_id", "left")

    def field(headers: str, name: str) -> Column:
        found = F.filter(lower_keys(F.col(headers)), lambda e: e["key"] == name)
        return F.regexp_replace(F.get(found, 0)["value"], "^W/", "") if name == "etag" else F.get(found, 0)["value"]

    tag, date = field("new", "etag"), field("new", "last-modified")
    same = F.when(tag.isNotNull(), tag.eqNullSafe(field("old", "etag"))).when(date.isNotNull(), date.eqNullSafe(field("old", "last-modified"))).otherwise(True)
    outcome = F.when(F.col("response_id").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    both = both.withColumn("outcome", outcome)
    held = F.col("outcome") == "resolved"
    return both.select(
        "record_id", "url", "ts", "response_id", "outcome", F.when(held, F.col("status")).alias("status"),
        F.when(held, merged_headers(F.col("old"), F.col("new"))).alias("headers"), F.when(held, F.col("body")).alias("body"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Two crawls of all pages as WARC records. In the first each page is a full response; in the second each
    URL, with another scheme, fragment and tracking parameter, answers not modified: mostly with the page's
    ETag, for every tenth with its date only, and for every tenth with the ETag of a version never seen."""
    page, tag = F.col("page_id"), F.md5(F.col("html").cast("binary"))
    date = F.concat(F.lit("day "), page)
    first = pages.select(
        (page * 2).alias("record_id"), "url", page.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Age"), F.lit("0")
        ).alias("headers"),
        F.col("html").alias("body"),
    )
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^http://", "https://"))
    other = F.concat(other, F.when(other.contains("?"), "&utm_campaign=again#top").otherwise("?utm_campaign=again#top"))
    kind = page % 10
    validators = F.when(kind == 3, F.create_map(F.lit("etag"), F.concat(F.lit("never-"), tag))).when(kind == 7, F.create_map(F.lit("last-modified"), date))
    validators = validators.otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag)))
    again = pages.select(
        (page * 2 + 1).alias("record_id"), other.alias("url"), (page + 1_000_000_000).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_concat(validators, F.create_map(F.lit("Age"), page.cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Cache"), F.lit("HIT"))).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(again)


def op1_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, folder, "pages")))
    heads = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select("record_id", "url", "ts", "response_id", "outcome", "status", heads.alias("headers"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, html, md5(html) AS tag FROM pages WHERE page_id IS NOT NULL),
r AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^http://', 'https://') AS u, tag FROM p),
v AS (SELECT page_id * 2 + 1 AS record_id, u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'utm_campaign=again#top' AS url,
        page_id + 1000000000 AS ts, page_id, tag FROM r),
a AS (SELECT page_id * 2 AS record_id, url, page_id AS ts, 1 AS fl FROM p UNION ALL SELECT record_id, url, ts, 0 FROM v),
b AS (SELECT record_id, ts, fl, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM a),
c AS (SELECT record_id, ts, fl,
        regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www[.]', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(regexp_replace(u, '^[^/?]*', ''), '^[^?]*', 0), '/+$', '') AS place,
        list_sort(list_filter(string_split(regexp_replace(u, '^[^?]*[?]?', ''), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_'))) AS q FROM b),
d AS (SELECT record_id, ts, fl, place || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM c),
e AS (SELECT record_id, fl, last_value(CASE WHEN fl = 1 THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY ts, record_id) AS response_id FROM d WHERE canonical IS NOT NULL),
f AS (SELECT v.record_id, v.url, v.ts, e.response_id, v.page_id, v.tag, o.page_id AS other, o.tag AS old_tag, o.html,
        CASE WHEN e.response_id IS NULL THEN 'missing'
             WHEN v.page_id % 10 = 3 THEN 'mismatch'
             WHEN v.page_id % 10 = 7 THEN CASE WHEN v.page_id = o.page_id THEN 'resolved' ELSE 'mismatch' END
             WHEN v.tag = o.tag THEN 'resolved' ELSE 'mismatch' END AS outcome
      FROM v LEFT JOIN e ON v.record_id = e.record_id LEFT JOIN p o ON e.response_id = o.page_id * 2)
SELECT record_id, url, ts, response_id, outcome, CASE WHEN outcome = 'resolved' THEN 200 END AS status,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(['age=' || page_id, 'content-length=' || octet_length(encode(html)), 'content-type=text/html', 'etag=' || old_tag,
    'last-modified=day ' || (CASE WHEN page_id % 10 = 7 THEN page_id ELSE other END), 'x-cache=HIT']), ';') END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM f
"""
