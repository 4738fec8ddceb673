"""Decontamination, rejection and the whole pipeline against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from bookweave.llm import decontamination, language_id, packing

SF = "/root/testdata/sf0.01"


def codes(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_overlaps(docs, items, window=13, share=0.8, least=5):
    """{(doc_id, item_id): most equal words on a diagonal that has a window with enough of them}."""
    found = {}
    for doc_id, text in docs:
        a = codes(text)
        for item_id, item in items:
            b = codes(item)
            need = min(window, len(b))
            if len(b) < least:
                continue
            for shift in range(-len(b) + 1, len(a)):
                pairs = [a[k + shift] == b[k] for k in range(max(0, -shift), min(len(b), len(a) - shift))]
                if any(sum(pairs[k : k + need]) >= math.ceil(need * share) for k in range(len(pairs) - need + 1)):
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), sum(pairs))
    return found


def test_masks_ignore_every_allowed_substitution():
    for words, changed in [(13, 2), (12, 2), (11, 2), (10, 2), (9, 1)]:
        for gone in itertools.combinations(range(words), changed):
            assert any(
                all(at + k not in gone for k, bit in enumerate(mask) if bit == "1")
                for mask in decontamination.MASKS for at in range(words - len(mask) + 1)
            ), (words, gone)


def test_overlaps_are_those_of_all_diagonals(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([9, 10, 11, 12, 13, 14, 20, 40, 13, 10])]
    docs = []
    for k in range(150):
        item = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(item) - 12))
        part = item[a : a + rng.choice([9, 13, 13, 20, 40])]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        docs.append((k, " ".join(rng.choices(vocabulary, k=rng.randrange(30))) + " " + ", ".join(part).upper() + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(30)))))
    got = {(r.doc_id, r.item_id): r.matched_words for r in decontamination.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute_overlaps(docs, items)
    assert got == want and len(want) > 60


def test_short_items_stand_word_for_word(spark):
    items = [(n, " ".join(f"s{n}w{k}" for k in range(n))) for n in range(1, 9)]
    docs = [(n, f"before {text} after it") for n, text in items] + [(100 + n, f"before {text.replace('w1', 'w9')} after") for n, text in items] + [(200, items[5][1])]
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(n, n) for n in range(5, 9)} | {(200, 6)} <= got <= set(brute_overlaps(docs, items))


def test_noise_is_rejected_and_given_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    kept = language_id.identify(docs, model).where("NOT rejected").count()
    assert kept >= 0.998 * docs.count()
    rng = random.Random(3)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=400)) for _ in range(50)]
    noise += ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200)) for _ in range(50)] + ["12 34 !", "", None]
    got = language_id.identify(spark.createDataFrame(list(enumerate(noise)), "doc_id bigint, text string"), model).collect()
    assert all(r.rejected for r in got)
    one = language_id.fit(docs.where("lang = 'en'"))  # a single language has no second best to lose against
    got = language_id.identify(spark.createDataFrame(list(enumerate(noise)), "doc_id bigint, text string"), one).collect()
    assert np.mean([r.rejected for r in got]) > 0.98


def test_sample_has_every_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rare = spark.createDataFrame([(10**6 + k, f"zyzzo quixa {k} brumo vlenk tarsu ploqu", "xx") for k in range(40)], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs.select("doc_id", "text", "lang").unionByName(rare), sample_rows=200)
    assert "xx" in model.languages
    got = language_id.identify(rare, model).collect()
    assert np.mean([r.lang_pred == "xx" for r in got]) > 0.9


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Given documents with planted noise, exact and near copies and benchmark passages, under a folder of their own."""
    rng = random.Random(12)
    given = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(170).collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given]
    long = [r for r in rows if 40 < len(r[1].split()) < 400]
    for k in range(12):
        words = rng.choice(long)[1].split(" ")
        rows.append((5000 + k, "  ".join(words) if k % 2 else "\t" + " ".join(words), "en", "copy", 1))
    for k in range(16):
        words = rng.choice(long)[1].split(" ")
        for _ in range(1 + k % 5):
            words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((6000 + k, " ".join(words), "en", "near", 1))
    for k in range(10):
        words = rng.choice(long)[1].split(" ")
        passage = rng.choice(bench)[1].split(" ")
        words[5:5] = passage[: 9 + 4 * k]
        rows.append((7000 + k, " ".join(words), "en", "leak", 1))
    rows += [(8000, None, "en", "x", 0), (8001, "", "en", "x", 0), (8002, " 12 34 -- ", "en", "x", 9), (8003, "中文" * 300, None, "x", 9)]
    rows += [(5000, rows[-20][1], "fr", "again", 1)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def brute_pipeline(rows, bench, gone):
    """The rows that each stage keeps. gone: ids that the first stage rejects (its model has no brute-force form)."""
    split = lambda t: re.split(r"[\x20\x09-\x0d]+", t.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}))
    stages = [[r for r in rows if r[0] not in gone]]
    least = {}
    for r in stages[-1]:
        key = re.sub(r"[\x20\x09-\x0d]+", " ", r[1])
        least[key] = min(least.get(key, r[0]), r[0])
    stages.append([r for r in stages[-1] if least[re.sub(r"[\x20\x09-\x0d]+", " ", r[1])] == r[0]])
    sets = []
    for r in stages[-1]:
        w = split(r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    group = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    first = {}
    for g, r in zip(group, stages[-1]):
        first[g] = min(first.get(g, r[0]), r[0])
    stages.append([r for g, r in zip(group, stages[-1]) if first[g] == r[0]])
    near = [(r[0], r[1]) for r in stages[-1]]
    # a leak needs 11 of 13 aligned words, so five of them stand in the item's own pairs of neighbours
    pairs = collections.defaultdict(set)
    for item_id, text in bench:
        w = codes(text)
        for k in range(len(w) - 1):
            pairs[w[k], w[k + 1]].add(item_id)
    leaked, texts = set(), dict(bench)
    for doc_id, text in near:
        w = codes(text)
        hits = collections.Counter(i for p in zip(w, w[1:]) for i in pairs.get(p, ()))
        items = [(i, texts[i]) for i, n in hits.items() if n >= 4]
        if brute_overlaps([(doc_id, text)], items):
            leaked.add(doc_id)
    stages.append([r for r in stages[-1] if r[0] not in leaked])
    return stages


def test_pipeline_is_the_brute_force_run(spark, fixture):
    import corpus_pipeline

    folder, rows, bench = fixture
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {r.doc_id for r in language_id.identify(docs, language_id.fit(docs)).where("rejected").collect()}
    assert gone >= {8000, 8001, 8002, 8003} and len(gone) <= 6
    want = brute_pipeline(rows, bench, gone)
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(r[:2] for r in kept), name
    assert len(want[0]) > len(want[1]) > len(want[2]) > len(want[3])
    pieces = collections.defaultdict(list)
    packs = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append(r)
        packs[r.sequence_id].append(r)
    encode = packing.encoder().encode_ordinary
    texts = {r[0]: r[1] for r in want[-1]}
    assert pieces.keys() == texts.keys()
    for doc_id, own in pieces.items():
        ids, at = np.array([*encode(texts[doc_id]), 1], "<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in packs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
