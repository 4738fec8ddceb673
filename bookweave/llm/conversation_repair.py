"""Repair of conversation structure at the least cost, by Hirschberg's divide and conquer over four states.

A repaired conversation has role initials ``(s?(ua)+)?``. The states are what stands before the next row: nothing,
``s``, ``u`` or ``a``. Legal next initials follow from the state, so the edits' initials (the audit) alone tell the
repaired roles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import is_small, stored, table

NONE, S, U, A = range(4)
STATES = (NONE, S, U, A)
INFINITE = 1 << 60
#: Costs of the edits, and of each truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: State after an initial that is legal in a state; the one legal choice of user or assistant in a state.
LEGAL = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
TURN = {NONE: U, S: U, U: A, A: U}
#: What has to be inserted behind the last row.
TAIL = {NONE: "", S: "II", U: "I", A: ""}
#: Rows of a conversation that one chunk holds, and their characters, about.
CHUNK_ROWS, CHUNK_CHARS = 4096, 4 << 20
#: Up to so many repeated (conversation, role, text) groups are broadcast; more are joined by shuffle.
SMALL_REPEATS = 500_000

#: A block of rows: for each state before it and each state right after its last row, the least cost and the place
#: of its least audit among those of the same state before (audits of equal start are never prefixes of each other).
Block = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]


@lru_cache(maxsize=None)
def row_edits(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """{(state before, state after): (cost, least audit)} of one row. kind: "d" for a row that must go, else its
    initial ("s", "u", "a" or "o" for any other), upper case if it is truncated."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for before in STATES:
        at, spent, audit = before, 0, ""
        for _ in range(3):  # more insertions than two come back to a state that fewer reach
            edits = [("D", DELETE, at)]
            if kind != "d":
                stays = TRUNCATED if kind.isupper() else 0
                edits.append(("R", REROLE + stays, TURN[at]))
                if (at, kind.lower()) in LEGAL:
                    edits.append(("K", stays, LEGAL[at, kind.lower()]))
            for letter, cost, after in edits:
                edit = (spent + cost, audit + letter)
                found[before, after] = min(found.get((before, after), edit), edit)
            at, spent, audit = TURN[at], spent + INSERT, audit + "I"
    return found


@lru_cache(maxsize=None)
def row_block(kind: str) -> Block:
    edits = row_edits(kind)
    cost = tuple(tuple(edits.get((a, b), (INFINITE, ""))[0] for b in STATES) for a in STATES)
    place = tuple(tuple(sorted(STATES, key=lambda b: edits.get((a, b), (0, "~"))[1]).index(b) for b in STATES) for a in STATES)
    return cost, place


def forward(start: Sequence[int], ranks: Sequence[int], blocks: Sequence[Block]) -> tuple[list[int], list[int]]:
    """Costs of the four states right after the blocks, and the order of their least audits."""
    costs, ranks = list(start), list(ranks)
    for cost, place in blocks:
        reached = []
        for b in STATES:
            least, rank, a = min((costs[a] + cost[a][b], ranks[a], a) for a in STATES)
            reached.append((least, (rank, place[a][b])))
        order = sorted(STATES, key=lambda b: reached[b][1])
        costs, ranks = [min(r[0], INFINITE) for r in reached], [order.index(b) for b in STATES]
    return costs, ranks


def backward(end: Sequence[int], blocks: Sequence[Block]) -> list[int]:
    """Costs from each of the four states before the blocks to the end."""
    costs = list(end)
    for cost, _ in reversed(blocks):
        costs = [min(INFINITE, min(cost[a][b] + costs[b] for b in STATES)) for a in STATES]
    return costs


def only(state: int) -> list[int]:
    return [0 if s == state else INFINITE for s in STATES]


def crossings(blocks: Sequence[Block], before: int, after: int) -> list[int]:
    """The state right after each block, on the audit-least way of least cost from one state to another.

    The middle crossing is chosen by the forward costs of the first half and the backward costs of the second;
    of equal sums, the one whose first half has the least audit. Then each half is solved alone."""
    found = [after] * len(blocks)
    todo = [(0, len(blocks), before, after)]
    while todo:
        low, high, a, b = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        there, ranks = forward(only(a), (0, 0, 0, 0), blocks[low:middle])
        onward = backward(only(b), blocks[middle:high])
        _, _, state = min((there[s] + onward[s], ranks[s], s) for s in STATES)
        found[middle - 1] = state
        todo += [(low, middle, a, state), (middle, high, state, b)]
    return found


def summary(blocks: Sequence[Block]) -> Block:
    """Consecutive blocks as one."""
    cost, place = [], []
    for a in STATES:
        costs, ranks = forward(only(a), (0, 0, 0, 0), blocks)
        cost.append(tuple(costs))
        place.append(tuple(ranks))
    return tuple(cost), tuple(place)


def last_state(blocks: Sequence[Block]) -> tuple[int, int]:
    """(state right after the last row, total cost) of the audit-least way of least cost, with its tail."""
    costs, ranks = forward(only(NONE), (0, 0, 0, 0), blocks)
    cost, _, state = min((costs[s] + INSERT * len(TAIL[s]), ranks[s], s) for s in STATES)
    return state, cost


def audit_of(kinds: str, before: int, after: int) -> str:
    """The least audit of the rows from one state to another, without a tail."""
    states = crossings([row_block(k) for k in kinds], before, after)
    return "".join(row_edits(k)[a, b][1] for k, a, b in zip(kinds, [before, *states], states))


@lru_cache(maxsize=100_000)
def whole_audit(kinds: str) -> tuple[str, int]:
    """(audit, cost) of a whole conversation. Short ones repeat, so the last ones are remembered."""
    state, cost = last_state([row_block(k) for k in kinds])
    return audit_of(kinds, NONE, state) + TAIL[state], cost


def repaired(audit: str, rows: Sequence[tuple[str, str]], state: int) -> Iterator[str]:
    """The repaired ``role:text`` rows."""
    at = 0
    for letter in audit:
        if letter != "I":
            role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        if letter == "K":
            state = LEGAL[state, role[:1]]
            yield f"{role}:{text}"
        else:
            state = TURN[state]
            yield f"{'user' if state == U else 'assistant'}:{text if letter == 'R' else ''}"


class Chunk:
    """Rows of one conversation that follow each other in one partition."""

    def __init__(self, conv_id):
        self.conv_id, self.kinds, self.rows, self.initials, self.faults, self.chars = conv_id, [], [], [], [0, 0, 0], 0
        self.turns: list = []  # first, last, number of different ones

    def add(self, turn, role, text, blank, truncated, copies, repeated):
        for k in range(copies):
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if blank:
                self.faults[0] += 1
                kind = "d"
            elif repeated or k:
                self.faults[1] += 1
                kind = "d"
            elif truncated:
                self.faults[2] += 1
                kind = kind.upper()
            self.kinds.append(kind)
            self.rows.append((role, "" if kind == "d" else text))
            self.initials.append(role[:1])
            self.chars += 16 + len(text)
        if copies and turn is not None:
            first, last, many = self.turns or (turn, None, 0)
            self.turns = [first, turn, many + (turn != last)]

    def full(self) -> bool:
        return len(self.kinds) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def illegal(self) -> int:
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as read, damaged by crc32 of ``conv_id:turn`` modulo 20; null ids, turns, roles and texts count
    as one space there, and null roles and texts are one afterwards. copies is 0 for a dropped row, 2 for a
    repeated one."""

    def some(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(some("role")).alias("role"),
        F.when(case == 0, "").otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds blank, truncated, and repeated: the same role and text stands earlier in the conversation.

    Only a hash of each text is grouped, and only groups of more than one row come back to the rows. _row tells
    rows apart that agree in everything; it is stored, so that a task that runs again gives the same."""
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumns(
        {
            "blank": end == "",
            "truncated": ~F.substring(end, -1, 1).isin("", ".", "!", "?"),
            "_text": F.md5(F.col("text").cast("binary")),
            "_row": F.monotonically_increasing_id(),
        }
    )
    rows = stored(rows, "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "_row")
    groups = rows.where("copies > 0").groupBy("conv_id", "role", "_text").agg(F.min(place).alias("first"), F.count("*").alias("many"))
    groups = groups.where("many > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_text").alias("_same"), "first")
    groups = stored(groups, "repair-repeats")
    groups = F.broadcast(groups) if is_small(groups, SMALL_REPEATS) else groups
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_same"))
    repeated = F.coalesce(place > F.col("first"), F.lit(False))
    return rows.join(groups, same, "left").withColumn("repeated", repeated).drop("_conv", "_role", "_same", "first", "_text")


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, repaired string"


def repair(conversations: DataFrame, texts: bool = True) -> DataFrame:
    """One row per conv_id of conv_id, turn, role and text rows: the counts of faults, the audit of the cheapest
    repair, its cost, and the repaired conversation: repaired (null unless ``texts``) and its sha256.

    Rows stand by turn (nulls first), then role and text. Blank rows have no character but white space; duplicate
    ones repeat a role and text; truncated ones end without ``.!?``. The first of these counts. A row with a null
    conv_id belongs to the conversation without an id. Missing ``copies`` mean 1 (see ``damaged``). Null roles and
    texts count as one space. An empty table gives an empty result; other columns are not read.

    1. The rows are dealt out by ranges of (conversation, turn, ...), so that a conversation of any length spreads
       over neighbouring partitions, and sorted.
    2. A conversation that lies within one chunk of a partition is repaired there. Of others, each chunk gives
       its four-state cost matrix (``summary``).
    3. The matrices of a conversation, one for ``CHUNK_ROWS`` rows, give the states between its chunks; then each
       chunk is repaired alone from state to state, and the pieces are joined in order."""
    rows = conversations if "copies" in conversations.columns else conversations.withColumn("copies", F.lit(1))
    nothing = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", nothing).alias("role"), F.coalesce("text", nothing).alias("text"), "copies")
    order = ["conv_id", "turn", "role", "text", "_row"]
    sorted_rows = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = sorted_rows.select("conv_id", "turn", "role", "text", "blank", "truncated", "copies", "repeated")
    id_type, turn_type = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    kinds = (
        f"conv_id {id_type}, part bigint, seq bigint, whole boolean, {RESULT}, kinds string, roles array<string>, texts array<string>, "
        f"matrix array<bigint>, faults array<bigint>, turns array<{turn_type}>, many bigint, ends array<string>"
    )
    names = [f.split()[0] for f in kinds.replace(", ", ",").split(",")]

    def chunked(batches):
        part = TaskContext.get().partitionId()
        count, pending = 0, None

        def out(chunk: Chunk, whole: bool) -> dict:
            nonlocal count
            count += 1
            row = {"conv_id": chunk.conv_id, "part": part, "seq": count, "whole": whole}
            faults = [*chunk.faults, chunk.illegal()]
            if whole:
                audit, cost = whole_audit("".join(chunk.kinds)) if len(chunk.kinds) <= 64 else whole_audit.__wrapped__("".join(chunk.kinds))
                text = "\n".join(repaired(audit, chunk.rows, NONE))
                shown = {"repaired": text} if texts else {}
                gaps = chunk.turns[1] - chunk.turns[0] + 1 - chunk.turns[2] if chunk.turns else 0
                return row | dict(zip(("blank", "duplicate", "truncated", "illegal"), faults)) | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest(text)} | shown
            cost, place = summary([row_block(k) for k in chunk.kinds])
            return row | {
                "kinds": "".join(chunk.kinds),
                "roles": [r for r, _ in chunk.rows],
                "texts": [t for _, t in chunk.rows],
                "matrix": [x for matrix in (cost, place) for line in matrix for x in line],
                "faults": faults,
                "turns": chunk.turns[:2],
                "many": chunk.turns[2] if chunk.turns else 0,
                "ends": [chunk.initials[0], chunk.initials[-1]] if chunk.initials else [],
            }

        def batch(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in found], type=types[n]) for n in names], names=names)

        chunk, first, continued, found, chars = None, True, False, [], 0
        for given in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in given.columns)):
                if chunk is None or conv_id != chunk.conv_id or chunk.full():
                    if chunk is not None:
                        same = conv_id == chunk.conv_id
                        found.append(out(chunk, not (same or continued or first)))
                        chars += chunk.chars
                        first = first and same
                        continued = same
                    chunk = Chunk(conv_id)
                chunk.add(*row)
                if len(found) >= 2000 or chars > 8 << 20:
                    yield batch(found)
                    found, chars = [], 0
        if chunk is not None:
            found.append(out(chunk, False))
        if found:
            yield batch(found)

    types = _arrow_types(id_type, turn_type, names)
    chunks = stored(sorted_rows.mapInArrow(chunked, kinds), "repair-chunks")
    columns = ["conv_id", *(f.split()[0] for f in RESULT.split(", "))]
    whole = chunks.where("whole").select(columns)
    return whole.unionByName(_joined(chunks.where("NOT whole"), id_type, turn_type, texts).select(columns))


def _arrow_types(id_type: str, turn_type: str, names: list[str]) -> dict[str, pa.DataType]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    types = dict.fromkeys(names, pa.int64())
    types |= dict.fromkeys(("audit", "repaired_sha256", "repaired", "kinds"), pa.string())
    types |= dict.fromkeys(("roles", "texts", "ends"), pa.list_(pa.string())) | dict.fromkeys(("matrix", "faults"), pa.list_(pa.int64()))
    return types | {"conv_id": kinds[id_type], "whole": pa.bool_(), "turns": pa.list_(kinds[turn_type])}


def in_order(rows: DataFrame, solve: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Streams each conversation's rows, by part and seq, through ``solve``."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    names = [f.split()[0] for f in schema.split(", ")]

    def each(batches):
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(given, itemgetter(0)):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*solve(group)), types)], names=names)

    return dealt.mapInArrow(each, schema)


def _joined(chunks: DataFrame, id_type: str, turn_type: str, texts: bool) -> DataFrame:
    """The conversations of several chunks, or at the edge of a partition."""
    kind = _arrow_types(id_type, turn_type, ["conv_id"])["conv_id"]

    def states(rows: Iterable[tuple]) -> Iterator[tuple]:
        group = list(rows)
        blocks = [tuple(tuple(tuple(m[16 * k + 4 * a : 16 * k + 4 * a + 4]) for a in STATES) for k in (0, 1)) for m in (r[3] for r in group)]
        last, cost = last_state(blocks)
        after = crossings(blocks, NONE, last)
        faults = [sum(r[4][k] for r in group) for k in range(4)]
        ends = [r[7] for r in group if r[7]]
        faults[3] += sum(a[1] + b[0] not in ("su", "ua", "au") for a, b in zip(ends, ends[1:]))
        turns = [(r[5], r[6]) for r in group if r[5]]
        many = sum(n for _, n in turns) - sum(a[1] == b[0] for (a, _), (b, _) in zip(turns, turns[1:]))
        gaps = turns[-1][0][1] - turns[0][0][0] + 1 - many if turns else 0
        for k, (row, a, b) in enumerate(zip(group, [NONE, *after], after)):
            yield (*row[:3], a, b, k == 0, k == len(group) - 1, gaps, *faults, cost)

    light = chunks.select("conv_id", "part", "seq", "matrix", "faults", "turns", "many", "ends")
    schema = f"conv_id {id_type}, part bigint, seq bigint, before bigint, after bigint, head boolean, tail boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    long = pa.int64()
    between = in_order(light, states, schema, [kind, *[long] * 4, pa.bool_(), pa.bool_(), *[long] * 6])
    pieces = chunks.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "kinds", "roles", "texts")
    pieces = between.join(pieces, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).drop("_part", "_seq")

    def solved(batches):
        for batch in batches:
            rows = batch.select(["kinds", "roles", "texts", "before", "after", "tail"]).to_pylist()
            audits = [audit_of(r["kinds"], r["before"], r["after"]) + (TAIL[r["after"]] if r["tail"] else "") for r in rows]
            pieces = ["\n".join(repaired(a, list(zip(r["roles"], r["texts"])), r["before"])) for r, a in zip(rows, audits)]
            kept = batch.select([n for n in batch.schema.names if n not in ("kinds", "roles", "texts")])
            left = [bool(a.strip("D")) for a in audits]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(audits, pa.string()), pa.array(pieces, pa.string()), pa.array(left)], names=[*kept.schema.names, "piece", "text", "left"])

    pieces = stored(pieces.mapInArrow(solved, f"{schema}, piece string, text string, left boolean"), "repair-pieces")

    def whole(rows: Iterable[tuple]) -> Iterator[tuple]:
        hashed, audit, shown, begun = hashlib.sha256(), [], [], False
        for row in rows:
            audit.append(row[13])
            if row[15]:
                text = f"\n{row[14]}" if begun else row[14]
                hashed.update(text.encode())
                begun = True
                if texts:
                    shown.append(text)
        yield (row[0], *row[7:13], "".join(audit), hashed.hexdigest(), "".join(shown) if texts else None)

    return in_order(pieces, whole, f"conv_id {id_type}, {RESULT}", [kind, *[long] * 6, *[pa.string()] * 3])


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair(damaged(table(spark, folder, "conversations")), texts=False).drop("repaired")
