"""Spelling variants against all pairs of words; the index against plain string search."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from bookweave.llm import spelling

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, word string, n string, near string, half string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_words(rows, noise, length=7, occurrences=2):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= occurrences}


def brute_variants(words, factor=10):
    near = collections.defaultdict(set)
    deleted = collections.defaultdict(set)  # words that share a one-deletion form, or are one, are candidates
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            deleted[x].add(w)
    for group in deleted.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_index_intervals_are_those_of_plain_search():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(60)})
    index = spelling.Vocabulary(words)
    codes = {chr(c): k + 2 for k, c in enumerate(index.alphabet)} | {"$": 1}
    text = "$" + "$".join(words) + "$"
    for right in (False, True):
        half, _ = index.side(right)
        for pattern in ["a", "ab", "$a", "b$", "é$a", "aab", "$"]:
            low, high = np.array([0]), np.array([half.n])
            for c in pattern if right else pattern[::-1]:
                low, high = half.extend(np.array([codes[c]]), low, high)
            assert high[0] - low[0] == sum(text.startswith(pattern, k) for k in range(len(text)))


@pytest.mark.parametrize("wide", [96, 2])
def test_both_searches_find_every_word_one_edit_apart(monkeypatch, wide):
    monkeypatch.setattr(spelling, "WIDE", wide)
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(900)} | {"aaaaaaaa", "aaaaaaaaa", "z" * 3000, "z" * 2999})
    index = spelling.Vocabulary(words)
    every = np.arange(len(words))
    found = {(words[a], words[b]) for right in (True, False) for a, b in zip(*index.near(every, right))}
    want = {(a, b) for a, b in itertools.permutations(words, 2) if one_edit(a, b)}
    assert found == want
    for right in (True, False):
        for a, b in zip(*index.near(every, right)):
            a, b = words[a], words[b]
            assert b.startswith(a[: len(a) // 2]) if right else b.endswith(a[len(a) // 2 :])


@pytest.mark.parametrize(("chars", "block"), [(1 << 20, 50_000), (200, 50_000), (1 << 20, 7)])
def test_variants(spark, monkeypatch, chars, block):
    monkeypatch.setattr(spelling, "INDEX_CHARS", chars)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    rng = random.Random(3)
    words = {}
    for k in range(250):
        base = "pre" + "".join(rng.choices("aeé", k=rng.randrange(1, 6))) + "end"
        words[base] = rng.randrange(1, 4)
    words |= {"letters": 1000, "lettres": 5, "leters": 3, "lettersx": 99, "letterx": 9, "letter": 10_000, "tie": 100, "ties": 10, "tin": 100, "x": 1, "y": 10, "é" * 5000: 1, "é" * 5001: 10}
    frame = spark.createDataFrame([(w, n, "z") for w, n in words.items()], "word string, n bigint, near string").repartition(3)
    got = spelling.variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(words) and set(map(tuple, got)) == brute_variants(words)


def test_vocabulary_of_odd_texts(spark):
    texts = ["Spelling SPELLING spelling, ÉCOLIERS écoliers Écoliers", None, "", " \t", "abcdefg" * 3000 + " x", "abcdefg" * 3000, "wörterbuch wörterbuch÷s naïvetés_naïvetés", "a1b2c3 short"]
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(None, "nobodys nobodys words"), (5, "repeated repeated rows")] * 2
    docs = spark.createDataFrame([(*r, "w", "n", "z", "h") for r in rows], KIND)
    for noise in (0, 2, 31):
        assert {r.word: r.n for r in spelling.vocabulary(docs, noise).collect()} == brute_words(rows, noise)
    none = spark.createDataFrame([], KIND)
    assert spelling.variants(spelling.vocabulary(none, 31)).collect() == []


def test_query_on_given_documents(spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spelling.op12_spelling_variants(spark, SF).collect()
    want = brute_variants(brute_words(given, 31))
    assert len(got) == len(want) and set(map(tuple, got)) == want
