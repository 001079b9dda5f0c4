"""Orders kept by heaps and pushes against ones made anew at each step."""

import random

import numpy as np
import pytest

from unravel.operators import cycles, policies


def graphs(n, count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        k = rng.randrange(1, n)
        yield cycles.neighbours((u, v) for u, v in ((rng.randrange(k), rng.randrange(k)) for _ in range(rng.randrange(1, 2 * n))) if u != v)


def plain_breaking(near):
    """Peel, take the vertices on cycles from all bridges, choose, again."""
    near, out = {v: set(ws) for v, ws in near.items()}, []
    degree = {v: len(ws) for v, ws in near.items()}

    def drop(v):
        for w in near.pop(v):
            near[w].discard(v)

    while True:
        while few := [v for v, ws in near.items() if len(ws) < 2]:
            drop(few[0])
        if not near:
            return out
        v = min(cycles.cyclic(near), key=lambda x: (-degree[x], x))
        for w in near[v]:
            degree[w] -= 1
        out.append(v)
        drop(v)


def plain_reinsertion(near, solution, strategy, each, merge_residual):
    left, out = set(solution), []
    links = [(u, v) for u in near if u not in left for v in near[u] if v not in left] if merge_residual else []
    back = [v for v in near if v not in left]
    while left:
        parts = {v: {v} for v in back}
        for u, v in links:
            if parts[u] is not parts[v]:
                parts[u] |= parts[v]
                for x in parts[v]:
                    parts[x] = parts[u]
        score = {v: policies.STRATEGIES[strategy]([len(p) for p in {id(parts[w]): parts[w] for w in near.get(v, ()) if w in parts}.values()]) for v in left}
        for v in sorted(left, key=lambda v: (score[v], v))[:each]:
            links += [(v, w) for w in near.get(v, ()) if w in back]
            back.append(v)
            left.discard(v)
            out.append(v)
    return out[::-1]


def test_breaking_cycles():
    for near in graphs(60, 150, 1):
        want = plain_breaking(near)
        assert cycles.break_cycles(near) == want and cycles.break_cycles(near, 2) == want[:2]


def test_on_cycle():
    for near in graphs(40, 60, 2):
        assert {v for v in near if cycles.on_cycle(near, v)} == cycles.cyclic(near)


@pytest.mark.parametrize("strategy", sorted(policies.STRATEGIES))
def test_reinsertion(strategy):
    rng = random.Random(3)
    for near in graphs(40, 60, 4):
        solution = [v for v in near if rng.random() < 0.6] + [1000]
        rng.shuffle(solution)
        for each, merge in ((1, False), (3, True), (1, True), (7, False)):
            assert policies.reinsertion(near, solution, strategy, each, merge) == plain_reinsertion(near, solution, strategy, each, merge)


def test_pagerank_order():
    """Against the solution of the linear equations for each residual graph."""
    for near in graphs(50, 40, 5):
        left, want = {v: set(ws) for v, ws in near.items()}, []
        while left:
            ids = sorted(left)
            at = {v: i for i, v in enumerate(ids)}
            a = np.zeros((len(ids), len(ids)))
            for v in ids:
                for w in left[v]:
                    a[at[w], at[v]] = 0.85 / len(left[v])
            x = np.linalg.solve(np.eye(len(ids)) - a, np.ones(len(ids)))
            v = ids[int(np.argmax(x >= x.max() - 1e-9))]
            want.append(v)
            for w in left.pop(v):
                left[w].discard(v)
        assert policies.pagerank_order(near) == policies.pagerank_order(near, direct=0) == policies.pagerank_order(near, direct=8) == want
    assert policies.pagerank_order({}) == [] and policies.degree_order({}) == []
