"""Conversation repair against a search over all edits, with chunks small enough that conversations span many."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from bookweave.llm import conversation_repair as cr

SF = "/root/testdata/sf0.001"
KIND = "conv_id bigint, turn bigint, role string, text string, kinds string, part string, audit string"
ROLES = ["system", "user", "assistant", "tool", "", None]


def brute_audit(kinds):
    """(cost, audit) least by cost, then text: uniform-cost search over (row, state) with the audit as tie-break."""
    moves = {0: "su", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, row, state = heapq.heappop(heap)
        if row == len(kinds) and state in (0, 3):
            return cost, audit
        if (row, state) in seen:
            continue
        seen.add((row, state))
        turn = moves[state][-1]
        heapq.heappush(heap, (cost + 2, audit + "I", row, state_of[turn]))
        if row < len(kinds):
            kind = kinds[row]
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, state))
            if kind != "d":
                more = int(kind.isupper())
                heapq.heappush(heap, (cost + 2 + more, audit + "R", row + 1, state_of[turn]))
                if kind.lower() in moves[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", row + 1, state_of[kind.lower()]))


def brute(rows, damage=True):
    out = {}
    for conv_id in {r[0] for r in rows}:
        after = []
        for _, turn, role, text, *_ in sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0)):
            case = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            after += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        counts, kinds, seen = [0, 0, 0], [], set()
        for _, role, text in after:
            full = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not full else 1 if (role, text) in seen else 2 if full[-1] not in ".!?" else None
            seen.add((role, text))
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if fault is not None:
                counts[fault] += 1
            kinds.append("d" if fault in (0, 1) else kind.upper() if fault == 2 else kind)
        cost, audit = brute_audit(kinds)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        turns = [t for t, *_ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        left, at, last = [], 0, ""
        for edit in audit:
            role, text = after[at][1:] if edit != "I" else ("", "")
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                left.append(f"{role}:{text}")
        text = "\n".join(left)
        out[conv_id] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(), text)
    return out


@pytest.mark.parametrize("size", [3, 6])
def test_hirschberg_finds_the_least_audit(size):
    for kinds in itertools.product("dsuaoSUAO", repeat=3) if size == 3 else [random.Random(k).choices("dsuaoSUAO", k=k % 40) for k in range(600)]:
        kinds = "".join(kinds)
        audit, cost = cr.whole_audit(kinds)
        assert (cost, audit) == brute_audit(kinds), kinds


def test_summaries_join_as_their_rows_do():
    rng = random.Random(5)
    for _ in range(300):
        kinds = "".join(rng.choices("dsuaoSUAO", k=rng.randrange(1, 30)))
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds) + 1) for _ in range(4))})
        parts = [kinds[a:b] for a, b in itertools.pairwise(cuts)] + [""]
        blocks = [cr.summary([cr.row_block(k) for k in p]) for p in parts]
        last, cost = cr.last_state(blocks)
        after = cr.crossings(blocks, cr.NONE, last)
        audit = "".join(cr.audit_of(p, a, b) for p, a, b in zip(parts, [cr.NONE, *after], after)) + cr.TAIL[last]
        assert (audit, cost) == cr.whole_audit(kinds)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["Fine.", "More", "", "  \t", "Same?", None, f"t{rng.random()}. ", f"x{turn}!"])
            out.append((conv, None if rng.random() < 0.05 else turn, rng.choice(ROLES if rng.random() < 0.3 else ["user", "assistant"]), text))
    out += [(1000, turn, ["user", "assistant"][turn % 2], f"turn {turn}{'.' if turn % 7 else ''}") for turn in range(400)]
    out += [(2000, 5, "user", "again.")] * 150 + [(None, None, None, None), (None, 3, "user", "é.\n" * 9000)]
    out += [(3000, None, "user", "a."), (3000, None, "user", "a."), (3001, 2**40, "assistant", "far."), (3001, 1, "user", "near.")]
    return out


@pytest.mark.parametrize("damage", [True, False])
def test_repair(spark, monkeypatch, rows, damage):
    monkeypatch.setattr(cr, "CHUNK_ROWS", 5)
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], KIND).repartition(3)
    got = {r[0]: tuple(r[1:]) for r in cr.repair(cr.damaged(docs) if damage else docs).collect()}
    want = brute(rows, damage)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    short = {r[0]: tuple(r[1:]) for r in cr.repair(cr.damaged(docs) if damage else docs, texts=False).collect()}
    assert short == {k: (*v[:-1], None) for k, v in want.items()}


def test_query_on_given_conversations_and_empty_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in cr.op13_conversation_repair(spark, SF).collect()}
    assert got == {k: v[:-1] for k, v in brute(given).items()}
    assert cr.repair(spark.createDataFrame([], KIND)).collect() == []
