"""Removal orders and scores over whole graphs."""

import random

import pytest

from unravel import catalog
from unravel.operators import cycles, policies
from unravel.plans.derive import order_pool

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(policies.SCORES))
def test_adaptive_is_scored_anew_each_time(name):
    rng = random.Random(4)
    for _ in range(12):
        near = cycles.neighbours((u, v) for u, v in ((rng.randrange(24), rng.randrange(24)) for _ in range(rng.randrange(10, 40))) if u != v)
        left, want = {v: set(ws) for v, ws in near.items()}, []
        while left:
            scores = policies.SCORES[name](left)
            v = min(left, key=lambda x: (-round(scores[x], 12), x))
            for w in left.pop(v):
                left[w].discard(v)
            want.append(v)
        assert policies.adaptive(near, policies.SCORES[name]) == want
        assert policies.adaptive(near, policies.SCORES[name], 3) == want[:3]


def test_queries_take_whole_graphs(spark):
    pool = order_pool(spark, SF)
    vertices = {(r.graph_id, r.id) for r in pool.vertices.select("graph_id", "id").collect()}
    for name in ("hda", "hpra", "hca", "hba", "betweenness_core"):
        rows = catalog.QUERIES[name](spark, SF).collect()
        assert len(rows) == len(vertices) and {(r.graph_id, r.id) for r in rows} == vertices
    gone = {(r.graph_id, r.id) for r in catalog.QUERIES["decycle_greedy"](spark, SF).collect()}
    edges = [(r.graph_id, r.src, r.dst) for r in pool.edges.collect()]
    left = cycles.neighbours(((g, u), (g, v)) for g, u, v in edges if (g, u) not in gone and (g, v) not in gone)
    assert gone and not cycles.cyclic(left)
