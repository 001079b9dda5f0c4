"""Betweenness by levels against searches in one task."""

import random

from unravel.operators import betweenness, cycles, policies


def test_against_searches(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(6):
        n = (3, 12, 25, 40, 2, 30)[g]
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range((3, 12, 40, 36, 1, 90)[g])}
        rows += [(g, u, v) for u, v in pairs]
        want |= {(g, v): x for v, x in policies.betweenness_scores(cycles.neighbours(pairs)).items()}
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long")
    for block in (64, 20):
        got = {(r.graph_id, r.id): r.score for r in betweenness.betweenness(edges, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert betweenness.betweenness(edges.limit(0)).count() == 0
