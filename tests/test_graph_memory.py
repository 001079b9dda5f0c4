"""What a task holds of a graph: arrays, a few dozen bytes a vertex."""

import tracemalloc

import numpy as np
import pytest

from unravel.operators import cycles, decycling, policies, robustness

N = 20_000


@pytest.fixture(scope="module")
def graph():
    rng = np.random.default_rng(1)
    ids = rng.permutation(N) + 10**9
    ends = np.unique(np.sort(rng.choice(ids, (N, 2)), axis=1), axis=0)
    return ids, ends[ends[:, 0] < ends[:, 1]]


def most(fn):
    tracemalloc.start()
    try:
        out = fn()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_curves(graph):
    assert most(lambda: robustness.curve_of(*graph))[1] < 120 * N
    assert most(lambda: decycling.cyclic_counts(*graph))[1] < 160 * N


def test_orders(graph):
    ids, ends = np.sort(graph[0]), graph[1]
    assert most(lambda: cycles.broken(ids, ends))[1] < 200 * N
    assert most(lambda: policies.put_back(ids, ends, graph[0][: N // 10], "rank", 600, False))[1] < 400 * N
