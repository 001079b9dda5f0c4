"""The cycle ratio along a solution against bridges made anew for each prefix."""

import random

import pytest

from unravel.operators import cycles, decycling, pool


@pytest.mark.parametrize("seed", range(12))
def test_counts_against_bridges(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 60)
    edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(0, 2 * n))} if n > 1 else set()
    ids = list(range(n))
    rng.shuffle(ids)
    want = []
    for k in range(n):
        left = set(ids[k:])
        want.append(len(cycles.cyclic(cycles.neighbours(e for e in edges if set(e) <= left))))
    assert decycling.cyclic_counts(ids, sorted(edges)) == want


def test_curve_steps_and_prefix(spark):
    ring = [(7, i, min(i, (i + 1) % 5), max(i, (i + 1) % 5), 1.0) for i in range(5)]
    e = spark.createDataFrame(ring, "graph_id long, edge_id long, src long, dst long, value double")
    sol = spark.createDataFrame([(7, i, i) for i in range(5)], "graph_id long, pos long, id long")
    counts = spark.createDataFrame([(7, 5, 5)], "graph_id long, n long, m long")
    curve = decycling.cycle_ratio_curve(sol, e, counts)
    assert [(r.k, r.cyclic, r.cnr) for r in curve.orderBy("k").collect()] == [(0, 5, 1.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0)]
    assert [tuple(r) for r in decycling.episode_steps(curve).collect()] == [(7, 0, 0, 1.0, True)]
    assert [r.id for r in decycling.prefix_above(curve, 0.5).collect()] == [0]


def test_pool(spark):
    e = spark.createDataFrame([(1, 0, 1, 2, 0.5)], "graph_id long, edge_id long, src long, dst long, value double")
    with pytest.raises(ValueError):
        pool.insert_graphs(e, e)
    grown = pool.add_edges(e, spark.createDataFrame([(1, 9, 2, 0.1), (1, 2, 1, 0.7), (1, 3, 3, 1.0), (2, 4, 5, 0.2)], "graph_id long, src long, dst long, value double"))
    assert sorted(tuple(r) for r in grown.collect()) == [(1, 0, 1, 2, 0.5), (1, 1, 2, 9, 0.1), (2, 0, 4, 5, 0.2)]
    assert pool.clear(e).count() == 0 and pool.get_graph(grown, 2).count() == 1
    assert {r.graph_id for r in pool.sample_graphs(grown, 20, 3).collect()} == {1, 2}
