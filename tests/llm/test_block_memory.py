"""A block of near copies is compared in a bounded share of an executor's memory."""

import tracemalloc

import numpy as np

from bookweave.llm.jaccard_join import links_in_group


def test_links_of_a_large_block_take_little_memory():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 62, 12)).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.random(len(base)) < 0.95], rng.integers(0, 1 << 62, 1).astype(np.uint64))) for _ in range(2048)]
    tracemalloc.start()
    got = links_in_group(sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * len(sets) ** 2
    for a, b in rng.integers(0, len(sets), (300, 2)):
        common = len(np.intersect1d(sets[a], sets[b]))
        assert got[a, b] == (a != b and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common))
