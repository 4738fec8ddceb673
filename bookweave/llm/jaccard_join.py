"""Exact n-gram Jaccard self-join by partitioning the shingle universe (pigeonhole), with one-deletion
neighbourhoods where a document's segments do not suffice."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import components, is_small, mix, slices, starts_of, stored, table, word_hashes, words_of

U = np.uint64
#: Shingles that a segment needs for its exact signature; thinner ones are too common and count as empty.
THICK = 1
#: Cells of the sketch that tells far apart sets without their shingles: how many shingles hash to each.
CELLS = 64
#: Members and shingles that one verification block holds, about.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 800_000
#: Rows of a square matrix of members that are worked on at a time, columns of its factor, and bytes of text.
STRIP, COLUMNS, PART_BYTES = 256, 1024, 2 << 20
#: Up to so many candidate ids (8 bytes each) are broadcast to pick their texts; more are joined by shuffle.
SMALL_IDS = 500_000


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes, text after text, and how many each text has.

    A text of fewer than n words (but at least one) has its whole word sequence as its one shingle."""
    words, counts = words_of(texts)
    h = word_hashes(words)
    begin = starts_of(counts)
    sizes = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    first = np.repeat(begin, sizes) + (np.arange(sizes.sum()) - np.repeat(starts_of(sizes), sizes))
    length = np.repeat(np.minimum(counts, n), sizes)
    hashed = mix(length.astype(U))
    for k in range(n):
        at = first + k
        inside = k < length
        hashed = np.where(inside, mix(hashed * U(0x2545F4914F6CDD1D) + h[np.where(inside, at, 0)]), hashed) if len(h) else hashed
    for a, b in zip(starts_of(sizes), np.cumsum(sizes)):
        hashed[a:b].sort()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[new], np.bincount(owner[new], minlength=len(sizes))


class Bands:
    """Size bands and their segment counts for 100 * |intersection| >= percent * |union|.

    Band k holds sizes low[k] .. low[k+1]-1, and a partner of a set in band k lies in bands k-1, k or k+1.
    Two sets that link and meet in band k's partition differ in at most ``differ[k]`` shingles. The segment
    count is that plus one plus a slack for thin segments, chosen by cost: more segments mean more
    signatures for each set, fewer mean more sets that need their one-deletion neighbourhoods."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            x = self.low[-1] + 1
            while -(-x * percent // 100) < self.low[-1]:
                x += 1
            self.low.append(x)
        self.low.append(-(-self.low[-1] * 100 // percent) + 1)
        self.differ, self.segments = [], []
        for k in range(len(self.low) - 1):
            top = self.low[k + 1] - 1
            most = top + top * 100 // percent
            d = most * (100 - percent) // (100 + percent)
            self.differ.append(d)
            self.segments.append(d + 1 + self.slack(d + 1, (self.low[k] + top) / 2))

    @staticmethod
    def slack(need: int, size: float) -> int:
        best, least = 0, math.inf
        for s in range(0, 2 + need // 4):
            each = size / (need + s)
            empty = (need + s) * math.exp(-each) * sum(each**k / math.factorial(k) for k in range(THICK))
            term, within = math.exp(-empty), 0.0  # thin segments, taken as a Poisson number
            for k in range(s + 1):
                within += term
                term *= empty / (k + 1)
            cost = need + s + (1 - min(1.0, within)) * (need + s + size)
            if cost < least:
                best, least = s, cost
        return best

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low), sizes, side="right") - 1


def signatures(sets: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set): what each set emits for its own band and for the one below.

    A signature is a hash of band, segment and the sum of the scrambled shingles in it. Of two sets that
    differ in d shingles, more than d segments of enough shingles in either set guarantee an equal one. Sets
    with fewer such segments emit their thin ones too, and each segment less one shingle; sets for which even
    that does not make the pigeonhole argument hold also emit every single shingle."""
    band = bands.of(np.maximum(counts, 1))
    differ, segments, low = np.array(bands.differ), np.array(bands.segments), np.array(bands.low)
    scrambled = mix(sets + U(0x51_7C_C1_B7))
    found_sig, found_own = [], []
    for step in (0, 1):
        b = band - step
        use = (counts > 0) & (b >= 0)
        b = np.maximum(b, 0)
        use &= differ[b] > 0
        if step:
            use &= counts <= (low[b + 1] - 1) * 100 // bands.percent
        m = np.where(use, segments[b], 0)
        base = starts_of(m)
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = use[owner]
        owner, x = owner[keep], scrambled[keep]
        if not len(x):
            continue
        seg = ((mix(x + b[owner].astype(U)) >> U(32)) * m[owner].astype(U) >> U(32)).astype(np.int64)
        cell = base[owner] + seg
        total = np.zeros(m.sum(), U)
        np.add.at(total, cell, x)
        filled = np.bincount(cell, minlength=m.sum())
        cell_owner = np.repeat(np.arange(len(counts)), m)
        salt = mix((b[cell_owner].astype(U) << U(32)) + (np.arange(m.sum()) - np.repeat(base, m)).astype(U) + U(1))
        thick = np.bincount(cell_owner, filled >= THICK, minlength=len(counts))
        poor = use & (thick < differ[b] + 1)
        used = (filled >= THICK) | (poor[cell_owner] & (filled > 0))
        found_sig.append(mix(total[used] + salt[used]))
        found_own.append(cell_owner[used])
        if poor.any():
            less = poor[owner] & (filled[cell] > 1)
            found_sig.append(mix(total[cell[less]] - x[less] + salt[cell[less]]))
            found_own.append(owner[less])
            reach = np.bincount(cell_owner, np.minimum(filled, 2), minlength=len(counts))
            every = (poor & (reach < differ[b] + 1))[owner]
            found_sig.append(mix(x[every] ^ mix(b[owner[every]].astype(U) + U(0xABCDEF))))
            found_own.append(owner[every])
    if not found_sig:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sig, own = np.concatenate(found_sig), np.concatenate(found_own)
    order = np.argsort(own, kind="stable")
    return sig[order], own[order]


def set_keys(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each whole set; empty sets have key 0."""
    keys = np.zeros(len(counts), U)
    np.add.at(keys, np.repeat(np.arange(len(counts)), counts), mix(sets ^ U(0x7F4A7C15_9E3779B9)))
    return np.where(counts > 0, mix(keys + counts.astype(U)), U(0))


def sketches(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles per cell, up to 255. The sum of differences of two sketches is at most the number of shingles
    in which the sets differ."""
    cell = (mix(sets + U(77)) >> U(58)).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.minimum(np.bincount(owner * CELLS + cell, minlength=len(counts) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)


def may_link(n: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a block may link, by their sizes and sketches: a square matrix without false negatives."""
    x, out = cells.astype(np.int16), np.zeros((len(n), len(n)), bool)
    for a in range(0, len(n), 64):
        apart = np.abs(x[a : a + 64, None, :] - x[None, :, :]).sum(2)
        out[a : a + 64] = apart <= (n[a : a + 64, None] + n[None, :]) * (100 - percent) // (100 + percent)
    np.fill_diagonal(out, False)
    return out


def groups_of(batches, keys: int):
    """Lists of rows that agree in their first columns, from sorted batches."""
    group: list = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def in_blocks(members: DataFrame, blocks) -> DataFrame:
    """(pivot, key) as (pivot, first, second, own, key, ...): each member goes to all pairs of blocks of its
    pivot that have its own block."""
    width = members.groupBy("pivot").agg(blocks.alias("blocks"))
    placed = members.join(width, "pivot").withColumn("own", F.pmod(F.xxhash64("key", "pivot"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
    return placed.drop("other", "blocks")


def links_in_group(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of a block link: a square matrix, from exact intersection sizes of sorted sets."""
    g = len(sets)
    n = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(g), n)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    new = np.ones(len(elements), bool)
    new[1:] = elements[1:] != elements[:-1]
    run = np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1
    column = np.cumsum(new & shared) - 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((g, g), np.int32)
    width = column[-1] + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        part = slice(*np.searchsorted(column, [c, c + COLUMNS]))
        held = np.zeros((g, min(COLUMNS, width - c)), np.float32)
        held[owner[part], column[part] - c] = 1
        for a in range(0, g, STRIP):
            common[a : a + STRIP] += (held[a : a + STRIP] @ held.T).astype(np.int32)
    linked = np.zeros((g, g), bool)
    for a in range(0, g, STRIP):
        both = common[a : a + STRIP].astype(np.int64)
        linked[a : a + STRIP] = 100 * both >= percent * (n[a : a + STRIP, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    return linked


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Documents link when their sets of distinct n-word shingles have 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach; n_links counts the linked documents.

    1. Each text becomes a set of shingle hashes; each set emits segment signatures (``signatures``).
    2. Signatures are dealt out and sorted by Spark. The smallest set key of a signature is its pivot, and
       (pivot, member) pairs are kept once. Two sets that link share a signature and so a pivot.
    3. The members of a pivot are compared in blocks of bounded size, first by sketches of 64 bytes, which
       leaves out most that are far from all others, then exactly: a task sees two blocks and
       sends on, for each member, the smallest one it reaches and its count of links. No pairs are sent.
    4. Connected components over these rows.

    Texts with equal sets share one key and are compared once. A pair that meets under several pivots is
    counted under the smallest. Sets and shingles are told apart by 64-bit hashes.

    Null and empty texts, or texts without words, have no shingles and link with nothing. Null ids never
    become a component's id unless they are alone. Repeated rows count as copies of each other. Texts of any
    length are read whole; an empty table gives an empty result; other columns are not read."""

    largest = 1 << 40

    def emit(batches):
        bands = None
        for batch in batches:
            for start, texts in slices(batch.column("text"), PART_BYTES):
                sets, counts = shingle_sets(texts, n)
                if bands is None or (len(counts) and counts.max() >= bands.low[-2]):
                    bands = Bands(percent, min(largest, 2 * int(counts.max(initial=1)) + 1000))
                sig, own = signatures(sets, counts, bands)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(counts))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(counts)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(set_keys(sets, counts).view(np.int64)),
                        pa.array([x.tobytes() for x in sketches(sets, counts)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "key", "cells", "sigs"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {id_type}, n_shingles bigint, key bigint, cells binary, sigs array<bigint>"), "jaccard-rows")
    full = rows.where("n_shingles > 0")

    def pivots(batches):
        last_sig = last_pivot = None
        for batch in batches:
            sig, key = (batch.column(k).to_numpy() for k in ("sig", "key"))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            new[0] = last_sig is None or sig[0] != last_sig
            at = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
            pivot = np.where(at >= 0, key[np.maximum(at, 0)], 0 if last_pivot is None else last_pivot)
            last_sig, last_pivot = sig[-1], pivot[-1]
            pairs = np.unique(np.stack([pivot, key], 1)[pivot != key], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["pivot", "key"])

    dealt = full.select(F.explode("sigs").alias("sig"), "key").repartition("sig").sortWithinPartitions("sig", "key")
    pairs = stored(dealt.mapInArrow(pivots, "pivot bigint, key bigint").distinct(), "jaccard-pairs")
    members = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("key")).distinct())

    # without members that are far from all others of their pivot, by size and sketch
    drawn = full.select("key", F.col("n_shingles").alias("n"), "cells").dropDuplicates(["key"])
    sketched = in_blocks(members, F.ceil(F.count("*") / BLOCK_MEMBERS)).join(drawn, "key").repartition("pivot", "first", "second")
    sketched = sketched.sortWithinPartitions("pivot", "first", "second").select("pivot", "first", "second", "key", "n", "cells")

    def near(batches):
        out: list = []

        def sent():
            rows = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["pivot", "key"])

        for group in groups_of(batches, 3):
            cells = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(-1, CELLS)
            some = may_link(np.array([r[4] for r in group]), cells, percent).any(1)
            out.append(np.array([(r[0], r[3]) for r in group], np.int64)[some])
            if len(out) > 2000:
                yield sent()
                out = []
        if out:
            yield sent()

    members = stored(sketched.mapInArrow(near, "pivot bigint, key bigint").distinct(), "jaccard-members")

    # the sets of the members, from the text of one document each
    keys = members.select("key").distinct()
    owners = full.join(keys, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    owners = stored(owners.where("doc_id IS NOT NULL"), "jaccard-owners")
    wanted = owners.select("doc_id")
    wanted = F.broadcast(wanted) if is_small(wanted, SMALL_IDS) else wanted

    def regain(batches):
        for batch in batches:
            for start, texts in slices(batch.column("text"), PART_BYTES):
                sets, counts = shingle_sets(texts, n)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_keys(sets, counts).view(np.int64)), pa.array([sets[b - c : b].tobytes() for b, c in zip(ends, counts)], pa.binary())],
                    names=["key", "shingles"],
                )

    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(regain, "key bigint, shingles binary").join(owners.select("key", "copies"), "key")
    sets = stored(sets.dropDuplicates(["key"]), "jaccard-sets")

    # the blocks of each pivot, and the pivots under which a member was met before
    sized = members.join(sets.select("key", (F.length("shingles") / 8).alias("n")), "key")
    met = members.groupBy("key").agg(F.array_sort(F.collect_set("pivot")).alias("met"))
    placed = in_blocks(sized, F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("n") / BLOCK_SHINGLES)))
    placed = placed.join(met, "key").withColumn("met", F.filter("met", lambda p: p < F.col("pivot")))
    grouped = placed.join(sets, "key").repartition("pivot", "first", "second").sortWithinPartitions("pivot", "first", "second")
    grouped = grouped.select("pivot", "first", "second", "own", "key", "shingles", "met", "copies")

    def compare(batches):
        def judged(group):
            pivot, first, second = group[0][:3]
            linked = links_in_group([np.frombuffer(r[5], U) for r in group], percent)
            label = np.array([r[4] for r in group])
            own = np.array([r[3] for r in group])
            if first != second:
                linked &= own[:, None] != own[None, :]
            places: dict[int, int] = {}
            at = [(k, places.setdefault(p, len(places))) for k, r in enumerate(group) for p in r[6]]
            strips = [slice(a, a + STRIP) for a in range(0, len(group), STRIP)]
            copies = np.array([r[7] for r in group], np.int64)
            seen = np.zeros((len(group), len(places)), np.float32)
            if at:
                seen[tuple(np.array(at).T)] = 1
            n_links = np.concatenate([(linked[a] & (seen[a] @ seen.T == 0)) @ copies for a in strips])
            reach = label.copy()
            top = np.iinfo(np.int64).max
            while True:
                better = np.minimum(reach, np.concatenate([np.where(linked[a], reach[None, :], top).min(1) for a in strips]))
                if (better == reach).all():
                    break
                reach = better
            some = linked.any(1)
            return label[some], reach[some], n_links[some]

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*done)], names=["key", "reach", "links"])

        done: list = []
        for group in groups_of(batches, 3):
            done.append(judged(group))
            if len(done) > 2000:
                yield sent()
                done = []
        if done:
            yield sent()

    judged = stored(grouped.mapInArrow(compare, "key bigint, reach bigint, links bigint"), "jaccard-links")
    ids = owners.select("key", F.col("doc_id").alias("node"))
    edges = judged.select("key", "reach").join(ids.select("key", F.col("node").alias("a")), "key")
    edges = edges.join(ids.select(F.col("key").alias("reach"), F.col("node").alias("b")), "reach").select("a", "b")
    reached = components(edges, "jaccard-edges")
    counts = judged.groupBy("key").agg(F.sum("links").alias("others"))
    found = ids.join(reached, "node").join(counts, "key").select("key", "component", "others")
    copies = full.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("same"))
    classes = copies.join(found, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "least", "doc_id")).otherwise(F.col("doc_id"))
    n_links = F.when(F.col("n_shingles") > 0, F.col("same") - 1 + F.coalesce("others", F.lit(0))).otherwise(F.lit(0))
    return (
        rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"))
        .join(classes, "key", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), n_links.cast("bigint").alias("n_links"))
    )


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), n=4, percent=85)


def keep_one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, with all its columns."""
    found = jaccard_components(docs, n, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
