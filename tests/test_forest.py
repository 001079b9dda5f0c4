"""Forests over joins against the forms that take a graph in one task."""

import random

import pytest

from unravel.operators import cycles, forest, robustness

EDGES = "graph_id long, edge_id long, src long, dst long"


def some_graphs(seed):
    """A tree, a path, a ring with tails, a star, random graphs, one edge."""
    rng = random.Random(seed)
    graphs = [
        [(i, rng.randrange(i)) for i in range(1, 60)],
        [(i, i + 1) for i in range(70)],
        [(i, (i + 1) % 12) for i in range(12)] + [(i, 12 + i) for i in range(12)] + [(5, 40), (40, 41), (41, 5)],
        [(0, i) for i in range(1, 50)] + [(1, 2)],
        [(rng.randrange(80), rng.randrange(80)) for _ in range(95)],
        [(rng.randrange(40), rng.randrange(40)) for _ in range(150)],
        [(3, 9)],
    ]
    rows = []
    for g, pairs in enumerate(graphs):
        names = list(range(1000))
        rng.shuffle(names)
        kept = sorted({(min(names[a], names[b]), max(names[a], names[b])) for a, b in pairs if a != b})
        rows += [(g, i, u, v) for i, (u, v) in enumerate(kept)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_graphs(1)


def test_bridges_and_cycles(spark, rows):
    edges = spark.createDataFrame(rows, EDGES)
    want = {(r.graph_id, r.src, r.dst) for r in cycles.bridges(edges).collect()}
    assert {(r.graph_id, r.src, r.dst) for r in forest.bridges(edges).collect()} == want
    on = {(r.graph_id, r.id) for r in cycles.cycle_vertices(edges).collect()}
    assert {(r.graph_id, r.id) for r in forest.cycle_vertices(edges).collect()} == on
    assert forest.bridges(edges.limit(0)).count() == 0


def test_spanning_forest(spark, rows):
    """The forest of greatest deaths, by adding edges in falling order."""
    rng = random.Random(2)
    deaths = {(g, e): rng.randrange(9) for g, e, _, _ in rows}
    edges = spark.createDataFrame([(*r, deaths[r[:2]]) for r in rows], EDGES + ", death long")
    root, want = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, e, u, v in sorted(rows, key=lambda r: (-deaths[r[:2]], -r[1])):
        a, b = find((g, u)), find((g, v))
        if a != b:
            root[a] = b
            want.add((g, e))
    assert {(r.graph_id, r.edge_id) for r in forest.boruvka(edges).picks.collect()} == want


def test_curve(spark, rows):
    """Every k of the curve, for orders with and without all vertices."""
    rng = random.Random(3)
    ids = sorted({(g, x) for g, _, u, v in rows for x in (u, v)})
    rng.shuffle(ids)
    at, sol = {}, []
    for g, x in ids:
        if g != 5 or x % 4:  # vertices outside of the solution are gone from the start
            sol.append((g, at.setdefault(g, 0), x))
            at[g] += 1
    solution, edges = spark.createDataFrame(sol, "graph_id long, pos long, id long"), spark.createDataFrame(rows, EDGES)
    counts = spark.createDataFrame([(g, sum(x[0] == g for x in ids)) for g in at], "graph_id long, n long")
    plain = lambda df: sorted((r.graph_id, r.k, r.pairs, round(r.conn, 9)) for r in df.collect())
    assert plain(forest.curve(solution, edges, counts)) == plain(robustness.robustness_curve(solution, edges, counts))
