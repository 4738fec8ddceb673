"""Nearest vectors: exact against numpy, approximate by its recall."""

import numpy as np
import pytest

from bookweave.operators import nearest as N
from bookweave.plans.model_plans import twentieths, vectors

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    rows = [(i, np.array(h, float)) for i, h in rows if h and any(h)]
    out = {}
    for name, q in queries:
        if not q or not any(q):
            continue
        q = np.array(q, float)
        best = sorted((round(1 - float(h @ q) / np.linalg.norm(h) / np.linalg.norm(q), 12), i) for i, h in rows)[:k]
        out[name] = [i for _, i in best]
    return out


def listed(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.id)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 12))
    out = [(f"v{k:04}", [float(x) for x in centres[k % 8] + rng.standard_normal(12)]) for k in range(900)]
    out += [("zero", [0.0] * 12), ("none", None), ("empty", [])]
    return out + [(f"copy{k:04}", [2.0 * x for x in out[3][1]]) for k in range(300)]  # a quarter has one direction


@pytest.mark.parametrize(("wave", "part_rows"), [(10_000, 100_000), (7, 100)])
def test_exact(spark, rows, wave, part_rows):
    corpus = spark.createDataFrame([(i, h, 1) for i, h in rows], "id string, h array<double>, part int")
    asked = [(k, h) for k, (_, h) in enumerate(rows) if k % 20 == 0 or h is None or not any(h)]
    queries = spark.createDataFrame(asked, "query_id bigint, q array<double>")
    want = brute(rows, asked, 5)
    got = listed(N.nearest(corpus, queries, 5, wave, part_rows))
    distance = {i: np.array(h, float) for i, h in rows if h and any(h)}
    for name, ids in want.items():
        q = np.array(dict(asked)[name], float)
        of = lambda i: 1 - distance[i] @ q / np.linalg.norm(distance[i]) / np.linalg.norm(q)  # noqa: E731, B023
        assert np.allclose([of(i) for i in got[name]], [of(i) for i in ids], atol=1e-12)
    assert got.keys() == want.keys() and all(len(set(v)) == 5 for v in got.values())
    assert N.nearest(corpus.limit(0), queries, 5).collect() == [] == N.nearest(corpus, queries.limit(0), 5).collect()


def test_approximate_recall(spark, rows):
    corpus = vectors(spark, SF).selectExpr("vec_id AS id", "h")
    exact, near = listed(N.nearest(corpus, twentieths(spark, SF), 10)), listed(N.nearest_lsh(corpus, twentieths(spark, SF), 10))
    assert np.mean([len(set(near[q]) & set(ids)) / len(ids) for q, ids in exact.items()]) >= 0.9
    small = spark.createDataFrame([(i, h) for i, h in rows], "id string, h array<double>")
    queries = spark.createDataFrame([(k, h) for k, (_, h) in enumerate(rows) if k % 20 == 0], "query_id bigint, q array<double>")
    exact, near = listed(N.nearest(small, queries, 5)), listed(N.nearest_lsh(small, queries, 5, bucket_rows=50, part_rows=60))
    assert exact.keys() == near.keys() and np.mean([len(set(near[q]) & set(ids)) / 5 for q, ids in exact.items()]) >= 0.9
    assert N.nearest_lsh(small.limit(0), queries, 5).collect() == []
