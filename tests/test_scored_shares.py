"""Orders of components apart, merged, against the order of the whole graph."""

import random

import pytest

from test_fast_orders import graphs
from unravel.operators import policies
from unravel.operators.cycles import neighbours

BOTH = [policies.closeness_scores, policies.betweenness_scores]


def parts_of(near):
    left = set(near)
    while left:
        part = policies.reached(near, [min(left)])
        left -= part
        yield {v: near[v] for v in part}


@pytest.mark.parametrize("score", BOTH)
def test_merged_order(score):
    for near in [*graphs(60, 40, 12), neighbours((k, k + 1) for k in range(300) if k % 7)]:
        want = policies.adaptive(near, score)
        widest, settled, still = policies.WITHIN[score](len(near)), {}, []
        for c, part in enumerate(parts_of(near)):
            order = policies.settled_order(part, score, widest)
            if order is None or c % 3 == 1:
                still.append(part)
            else:
                settled[c] = order
        assert policies.merged_order(settled, still, score) == want
        assert policies.merged_order(settled, still, score, 5) == want[:5]
        # ties that the size of the graph decides
        assert policies.merged_order({}, list(parts_of(near)), score) == want
    assert policies.settled_order(neighbours([(0, 1), (1, 2)]), policies.betweenness_scores, 10**13) is None


@pytest.mark.parametrize("name", ["closeness", "betweenness"])
def test_shares(spark, monkeypatch, name):
    monkeypatch.setattr(policies, "SHARE_EDGES", 40)
    monkeypatch.setattr(policies, "ALONE", 12)
    rng, rows = random.Random(4), set()
    for g in range(2):
        rows |= {(g, *sorted(rng.sample(range(150), 2))) for _ in range(110)}
    want = set()
    for g in range(2):
        near = neighbours((a, b) for x, a, b in rows if x == g)
        want |= {(g, k, v) for k, v in enumerate(policies.adaptive(near, policies.SCORES[name]))}
    edges = spark.createDataFrame(sorted(rows), "graph_id long, src long, dst long")
    assert {tuple(r) for r in policies.adaptive_order(edges, name).collect()} == want
