"""Scores of connected graphs in arrays against ones searched vertex by vertex."""

import random

import pytest

from test_fast_orders import graphs
from unravel.operators import policies
from unravel.operators.cycles import neighbours


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(policies, "SMALL", 2)
    monkeypatch.setattr(policies, "BALLS", 2000)
    monkeypatch.setattr(policies, "STEPS", 300)


def connected():
    for near in graphs(90, 60, 4):
        left = set(near)
        while left:
            part = policies.reached(near, [next(iter(left))])
            left -= part
            if len(part) > 2:
                yield {v: near[v] for v in part}
    yield neighbours((k, k + 1) for k in range(200))
    yield neighbours((k, (k + 1) % 130) for k in range(130))
    yield neighbours((0, k) for k in range(1, 200))


def test_scores():
    for near in connected():
        assert policies.whole_closeness(near) == policies.closeness_scores(near)
        assert policies.whole_betweenness(near) == pytest.approx(policies.betweenness_scores(near), abs=1e-12)


@pytest.mark.parametrize("score", [policies.closeness_scores, policies.betweenness_scores])
def test_orders(score):
    for near in graphs(60, 15, 6):
        left, plain = {v: set(ws) for v, ws in near.items()}, []
        while left:
            found = score(left)
            plain.append(min(left, key=lambda v: (-round(found[v], 12), v)))
            for w in left.pop(plain[-1]):
                left[w].discard(plain[-1])
        assert policies.adaptive(near, score) == plain


def test_thousands_of_vertices(monkeypatch):
    """Vertex by vertex, this takes minutes."""
    monkeypatch.undo()
    rng = random.Random(2)
    near = neighbours((u, v) for u, v in ((rng.randrange(4000), rng.randrange(4000)) for _ in range(4400)) if u != v)
    for score in (policies.closeness_scores, policies.betweenness_scores):
        assert len(set(policies.adaptive(near, score, 30))) == 30
