"""Packing: shortest pack first over the length histogram; documents find their places by rank."""

from __future__ import annotations

import base64
import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bookweave.llm.common import slices, stored, table

VOCABULARY = "byte_bpe_50k.tiktoken"
SEQUENCE, END = 2048, 1
_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The byte-level BPE of the named vocabulary file; its ranks are the ids of byte_bpe_50k.json."""
    path = public_tokenizers.path(vocabulary)
    if path not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


@dataclass(frozen=True)
class Plan:
    """Runs of equal pieces, sorted by (length, first rank, first token): ranks ``rank`` to ``rank + count`` of
    the whole pieces of ``length`` tokens put ``size`` tokens from ``begin`` on at ``offset`` of the sequences
    from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def shortest_pack_first(histogram: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    """Place lengths longest first, always into the shortest packs, until all are placed.

    There are ceil(tokens / capacity) packs from the start, all empty. A pattern is a run of sequences that
    were filled alike; placing n pieces of a length splits at most one pattern, so there are at most capacity
    + 1 of them. If a length does not fit even the shortest pack, the piece is cut there, and its rest counts
    as a shorter length. So all sequences but the last tokens of the whole set are filled."""
    total = sum(k * n for k, n in histogram.items())
    packs = -(-total // capacity)
    heap = [(0, 0, packs)] if packs else []  # (filled, first sequence, sequences)
    todo: dict[int, list[tuple[int, int, int, int]]] = {k: [(k, 0, n, 0)] for k, n in histogram.items() if n and k}
    runs = []
    for size in range(capacity, 0, -1):
        work = todo.pop(size, [])
        while work:
            length, rank, n, begin = work.pop()
            while n:
                filled, first, width = heapq.heappop(heap)
                free, used = capacity - filled, min(n, width)
                placed = min(size, free)
                runs.append((length, rank, used, begin, placed, first, filled))
                if placed < size:
                    todo.setdefault(size - placed, []).append((length, rank, used, begin + placed))
                if placed < free:
                    heapq.heappush(heap, (filled + placed, first, used))
                if used < width:
                    heapq.heappush(heap, (filled, first + used, width - used))
                rank, n = rank + used, n - used
    columns = np.array(sorted(runs), np.int64).reshape(-1, 7).T
    order = np.lexsort((columns[3], columns[1], columns[0]))
    length, rank, count, begin, size, sequence, offset = columns[:, order]
    return Plan(length, rank, count, begin, size, sequence, offset, packs)


def base_pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """Documents as tokens, cut after every ``capacity``: doc_id, start, length, doc_tokens, ids_crc32, the
    task that made the piece, its rank among the task's pieces of this length, and the ids of shorter pieces
    (a full piece is never cut again, so its checksum is enough)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                out = []
                for doc_id, text in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), texts.to_pylist()):
                    ids = np.append(encode.encode_to_numpy(text, disallowed_special=()), np.uint32(END)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        n = len(piece)
                        short = piece.astype("<u2" if encode.max_token_value < 1 << 16 else "<u4").tobytes() if n < capacity else None
                        out.append((doc_id, start, n, len(ids), zlib.crc32(piece.tobytes()), part, int(seen[n]), short))
                        seen[n] += 1
                names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "part", "local_rank", "ids"]
                types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    kind = f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, part bigint, local_rank bigint, ids binary"
    return docs.select("doc_id", "text").mapInArrow(cut, kind)


def pack(docs: DataFrame, capacity: int = SEQUENCE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts become ids, then id 1; null counts as empty, and an empty text is the one token 1. Pieces of equal
    length are ranked (by task, then order in the task), the plan is made from the histogram of at most
    ``capacity`` lengths, and each piece looks its places up by length and rank. The plan's runs go to the
    tasks; their number is bounded by capacity, not by the data. Null ids and repeated rows are packed like
    any other row; an empty table gives an empty result; other columns are not read."""
    pieces = stored(base_pieces(docs, capacity, vocabulary), "packing-pieces")
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = shortest_pack_first(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(ranks, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    wide = "<u2" if encoder(vocabulary).max_token_value < 1 << 16 else "<u4"

    def place(batches):
        group = np.searchsorted(plan.length, np.arange(capacity + 2))
        for batch in batches:
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("start", "length", "doc_tokens", "ids_crc32", "rank")}
            ids, out = batch.column("ids"), []
            for k, (start, n, tokens, crc, rank) in enumerate(zip(*columns.values())):
                first, last = group[n], group[n + 1]
                at = first + int(np.searchsorted(plan.rank[first:last], rank, side="right")) - 1
                places = []
                while at >= first and sum(plan.size[p] for p in places) < n:  # runs of one piece may lie apart
                    if plan.rank[at] <= rank < plan.rank[at] + plan.count[at]:
                        places.append(at)
                    at -= 1
                places.sort(key=lambda p: plan.begin[p])
                whole = None if len(places) == 1 else np.frombuffer(ids[k].as_py(), wide).astype("<u4")
                for p in places:
                    b, size = int(plan.begin[p]), int(plan.size[p])
                    check = crc if whole is None else zlib.crc32(whole[b : b + size].tobytes())
                    out.append((k, start + b, size, check, tokens, plan.sequence[p] + rank - plan.rank[p], plan.offset[p]))
            table = np.array(out, np.int64).reshape(-1, 7).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(table[0])), *[pa.array(c) for c in table[1:]]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "rank", "ids")
    return ranked.mapInArrow(place, kind)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
