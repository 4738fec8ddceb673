"""The LSH forest against all pairs, with regions small enough that they go deeper."""

import random
import re

import duckdb
import numpy as np
import pytest

from bookweave.llm import lsh_forest

KIND = "doc_id bigint, text string, key string, pivot string, region string, heads string, kept string"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, percent):
    """(doc_id, n_shingles, component_id, kept) of each row, from all pairs of rows."""
    sets = [shingles(r[1], n) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(g), r[0] == least.get(g)) for r, s, g in zip(rows, sets, group)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    out = []
    for k in range(60):  # near copies of one text, some of them below the threshold to each other
        near = list(base)
        for _ in range(k % 7):
            near[rng.randrange(len(near))] = f"edit{rng.random()}"
        out.append((k + 5, " ".join(near)))
    for k in range(40):  # one passage that many share
        out.append((100 + k, " ".join(base[:50] + [rng.choice(vocabulary) for _ in range(40)])))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (203, "one"), (205, "one two"), (None, "one"), (None, "alone here"), (206, "a b c d e f g h"), (207, "a b c d e f g h i")]
    out += [(208, "word " * 20_000), (209, "word " * 20_000 + "end"), (None, " ".join(base)), (4, "É é A"), (3, "É é a")]
    return out


@pytest.mark.parametrize(("n", "percent", "region"), [(3, 85, 512), (3, 85, 8), (5, 80, 512), (1, 60, 8)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, rows, n, percent, region):
    monkeypatch.setattr(lsh_forest, "REGION", region)
    monkeypatch.setattr(lsh_forest.candidate_regions, "__defaults__", (region,))
    monkeypatch.setattr(lsh_forest, "BLOCK_MEMBERS", 16)
    docs = spark.createDataFrame([(*r, *"abcde") for r in rows], KIND)
    got = sorted(map(tuple, lsh_forest.near_duplicates(docs, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_empty_table(spark):
    assert lsh_forest.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def test_prefixes_agree_as_often_as_similarity_says():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64 - 1, 600, np.uint64)) for _ in range(40)]
    near = [np.unique(np.concatenate([s[:570], rng.integers(0, 2**64 - 1, 30, np.uint64)])) for s in sets]
    whole = [x for pair in zip(sets, near) for x in pair]
    heads = lsh_forest.prefixes(np.concatenate(whole), np.array([len(x) for x in whole]), 2)
    share = (heads[0::2] == heads[1::2]).mean()
    assert abs(share - (570 / 630) ** 2) < 0.04 and (heads[0:-2:2] == heads[2::2]).mean() < 0.01


def test_depth_keeps_the_miss_below_its_bound():
    for percent in (50, 80, 85, 95):
        d = lsh_forest.base_depth(percent)
        assert d == 1 or (1 - (percent / 100) ** d) ** lsh_forest.TREES <= lsh_forest.MISS


def test_sql_of_both_joins(spark):
    from bookweave.llm.jaccard_join import op4_ngram_jaccard_join
    from bookweave.llm.jaccard_sql import OP4_SQL, OP11_SQL

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for run, sql in [(op4_ngram_jaccard_join, OP4_SQL), (lsh_forest.op11_lsh_forest, OP11_SQL)]:
        df, cur = run(spark, folder), con.execute(sql)
        assert sorted(map(tuple, df.select([d[0] for d in cur.description]).collect())) == sorted(cur.fetchall())
