"""MinHash near-duplicates by an LSH forest: sorted signature orders, neighbours by longest common prefix, a depth
that adapts to each region, and exact confirmation on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import components, is_small, mix, slices, starts_of, stored, table
from bookweave.llm.jaccard_join import CELLS, groups_of, in_blocks, links_in_group, may_link, set_keys, shingle_sets, sketches

U = np.uint64
#: Signature orders (trees), and the chance that a pair just at the threshold shares no region of any of them.
TREES, MISS = 32, 1e-9
#: A region of more sets than this goes deeper.
REGION = 2048
#: Members and shingles that one verification block holds, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 800_000
#: Up to so many candidate ids (8 bytes each) are broadcast to pick their texts; more are joined by shuffle.
SMALL_IDS = 500_000


def base_depth(percent: int, trees: int = TREES, miss: float = MISS) -> int:
    """The largest common prefix that pairs at the threshold still share in some tree, but for ``miss`` of them."""
    depth = 1
    while (1 - (percent / 100) ** (depth + 1)) ** trees <= miss:
        depth += 1
    return depth


def prefixes(sets: np.ndarray, counts: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """One 64-bit hash per set and tree: the first ``depth`` minhash values of that tree's order.

    Two sets have an equal value with a chance of (Jaccard similarity) ** depth. Empty sets get zeros."""
    out = np.zeros((len(counts), trees), U)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = starts_of(counts)[full]
    seeds = mix(np.arange(1, 2 * trees * depth + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    short = (sets >> U(32)).astype(np.uint32)
    head = np.zeros((len(full), trees), U)
    # blocks of sets whose shingles stay in the processor's cache
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(short), 16_384)), len(full)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        x = short[begin[a] : begin[b] if b < len(begin) else None]
        at = begin[a:b] - begin[a]
        for t in range(trees):
            h = np.full(b - a, U(t + 1))
            for d in range(depth):
                k = 2 * (t * depth + d)
                scrambled = (x ^ seeds[k].astype(np.uint32)) * (seeds[k + 1].astype(np.uint32) | np.uint32(1))
                scrambled ^= scrambled >> np.uint32(15)
                least = np.minimum.reduceat(scrambled * np.uint32(0x2C1B3C6D), at)
                h = mix(h * U(0x2545F4914F6CDD1D) + least.astype(U))
            head[a:b, t] = h
    out[full] = head
    return out


def candidate_regions(sets: DataFrame, region: int = REGION) -> DataFrame:
    """(pivot, key): the members of each region with more than one set, under the region's smallest key.

    A tree's order is cut into regions of equal prefix. A region of at most ``region`` sets gives its members as
    they are. Larger ones go deeper: their sets are ordered anew by the prefixes of each two dense trees, so
    that neighbours share twice the depth. Two sets that share regions share one that is not dense, or else two
    dense ones, unless they share a single one; a common passage alone rarely makes them share two."""
    orders = sets.select("key", F.posexplode("heads").alias("tree", "region"))
    sizes = orders.groupBy("region").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    placed = orders.join(stored(sizes, "forest-regions"), "region")
    shallow = placed.where(F.col("size") <= region).select("pivot", "key")
    dense = placed.where(F.col("size") > region).groupBy("key").agg(F.array_sort(F.collect_set("tree")).alias("trees"))
    two = F.flatten(F.transform("trees", lambda a: F.transform(F.filter("trees", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    deeper = dense.join(sets.select("key", "heads"), "key").select("key", "heads", F.explode(two).alias("two"))
    deeper = deeper.select("key", F.xxhash64("two.a", "two.b", F.get("heads", F.col("two.a")), F.get("heads", F.col("two.b"))).alias("region"))
    pivots = deeper.groupBy("region").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    return shallow.unionByName(deeper.join(pivots, "region").select("pivot", "key")).where("pivot <> key").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when their sets of distinct n-word shingles have 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach; kept marks the document that has it.

    1. Each text becomes a set of shingle hashes and a prefix hash per tree (``prefixes``).
    2. Distinct sets that share a region of a tree become candidates (``candidate_regions``).
    3. The members of a pivot are compared in blocks of bounded size: by sketches of 64 bytes, which leaves out
       most that are far from all others, then exactly. Each member sends the smallest one it reaches.
    4. Connected components over these rows. Equal sets share one key and are compared once.

    Every link that is reported is exact. A link can be missed only if the two sets share no region, or a single
    dense one: for a pair just at the threshold a chance of ``MISS``, or 2e-9 at 85 % where every region is
    dense, and far less for closer pairs.

    Null and empty texts, or texts without words, have no shingles and link with nothing. Null ids never become
    a component's id unless they are alone, and then they are kept. Repeated rows count as copies of each
    other and of one id. Texts are read whole; an empty table gives an empty result; other columns are not
    read. Sets and shingles are told apart by 64-bit hashes."""
    depth = base_depth(percent, trees)

    def emit(batches):
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                sets, counts = shingle_sets(texts, n)
                heads = prefixes(sets, counts, depth, trees)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(counts)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(set_keys(sets, counts).view(np.int64)),
                        pa.array([x.tobytes() for x in sketches(sets, counts)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, heads.size + 1, trees, dtype=np.int32)), pa.array(heads.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "key", "cells", "heads"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, n_shingles bigint, key bigint, cells binary, heads array<bigint>"
    rows = stored(docs.select("doc_id", "text").mapInArrow(emit, kinds), "forest-rows")
    full = rows.where("n_shingles > 0")
    sets = full.select("key", F.col("n_shingles").alias("n"), "cells", "heads").dropDuplicates(["key"])
    # a set of fewer than 1 / (1 - percent / 100) shingles links with equal sets only
    sets = stored(sets.where(F.col("n") >= math.ceil(100 / (100 - percent)) - 1) if percent < 100 else sets.limit(0), "forest-sets")

    pairs = stored(candidate_regions(sets), "forest-pairs")
    members = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("key")).distinct())
    drawn = sets.select("key", "n", "cells")
    sketched = in_blocks(members, F.ceil(F.count("*") / BLOCK_MEMBERS)).join(drawn, "key").repartition("pivot", "first", "second")
    sketched = sketched.sortWithinPartitions("pivot", "first", "second").select("pivot", "first", "second", "key", "n", "cells")

    def near(batches):
        for group in groups_of(batches, 3):
            cells = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(-1, CELLS)
            some = may_link(np.array([r[4] for r in group]), cells, percent).any(1)
            found = np.array([(r[0], r[3]) for r in group], np.int64)[some]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["pivot", "key"])

    members = stored(sketched.mapInArrow(near, "pivot bigint, key bigint").distinct(), "forest-members")

    # the sets of the members, from the text of one document each
    owners = full.join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("node"))
    owners = stored(owners.where("node IS NOT NULL"), "forest-owners")
    wanted = owners.select(F.col("node").alias("doc_id"))
    wanted = F.broadcast(wanted) if is_small(wanted, SMALL_IDS) else wanted

    def regain(batches):
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                found, counts = shingle_sets(texts, n)
                ends = np.cumsum(counts)
                whole = [found[b - c : b].tobytes() for b, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(found, counts).view(np.int64)), pa.array(whole, pa.binary())], names=["key", "shingles"])

    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    regained = texts.mapInArrow(regain, "key bigint, shingles binary").join(owners.select("key"), "key", "left_semi")
    regained = stored(regained.dropDuplicates(["key"]), "forest-shingles")

    sized = members.join(regained.select("key", (F.length("shingles") / 8).alias("n")), "key")
    placed = in_blocks(sized, F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)))
    grouped = placed.join(regained, "key").repartition("pivot", "first", "second").sortWithinPartitions("pivot", "first", "second")
    grouped = grouped.select("pivot", "first", "second", "key", "shingles")

    def compare(batches):
        top = np.iinfo(np.int64).max
        for group in groups_of(batches, 3):
            linked = links_in_group([np.frombuffer(r[4], U) for r in group], percent)
            label = np.array([r[3] for r in group])
            reach = label
            while True:
                better = np.minimum(reach, np.where(linked, reach[None, :], top).min(1))
                if (better == reach).all():
                    break
                reach = better
            some = reach < label
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(label[some]), pa.array(reach[some])], names=["key", "reach"])

    links = stored(grouped.mapInArrow(compare, "key bigint, reach bigint").distinct(), "forest-links")
    edges = links.join(owners.select("key", F.col("node").alias("a")), "key")
    edges = edges.join(owners.select(F.col("key").alias("reach"), F.col("node").alias("b")), "reach").select("a", "b")
    found = owners.join(components(edges, "forest-edges"), "node").select("key", "component")
    classes = full.groupBy("key").agg(F.min("doc_id").alias("least")).join(found, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "least", "doc_id")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"))
        .join(classes, "key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op11_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), n=3, percent=85)
