"""PageRank orders of components apart, merged, against the order of the whole graph."""

import random

import pytest

from unravel.operators import policies
from unravel.operators.cycles import neighbours


@pytest.mark.parametrize("most", [None, 40])
def test_merged_shares(spark, monkeypatch, most):
    rng = random.Random(8)
    rows = set()
    for g in range(2):
        for part in range(60):  # small components, many of one shape
            k = rng.randrange(2, 9)
            ids = rng.sample(range(part * 10, part * 10 + 10), k)
            rows |= {(g, min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])}
            a, b = rng.sample(ids, 2)
            rows.add((g, min(a, b), max(a, b)))
        rows |= {(g, 700 + k % 3, 800 + k) for k in range(30)}
    want = set()
    for g in range(2):
        near = neighbours((a, b) for x, a, b in rows if x == g)
        want |= {(g, k, v) for k, v in enumerate(policies.pagerank_order(near, most))}
    edges = spark.createDataFrame(sorted(rows), "graph_id long, src long, dst long")
    monkeypatch.setattr(policies, "SHARE_EDGES", 30)
    got = policies.adaptive_order(edges, "pagerank", most)
    assert {tuple(r) for r in got.collect()} == want
    monkeypatch.setattr(policies, "SHARE_EDGES", 10**6)
    assert {tuple(r) for r in policies.adaptive_order(edges, "pagerank", most).collect()} == want
