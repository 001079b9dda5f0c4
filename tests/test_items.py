"""Generators, reports, greedy influence, given solutions."""

import collections
import glob
import random

import pytest

from unravel.operators import cascade, cycles, policies, robustness
from unravel.sources import generators, graph_files


@pytest.mark.parametrize("seed", range(4))
def test_power_law_cluster(seed):
    n, m = 200, 4
    edges = generators.power_law_cluster(n, m, 0.9, seed)
    near = cycles.neighbours(edges)
    assert len(edges) == len(set(edges)) == m * (n - m) and all(a < b for a, b in edges)
    assert generators.power_law_cluster(n, m, 0.9, seed) == edges
    closed = lambda es: sum(len(x[a] & x[b]) for x in [cycles.neighbours(es)] for a, b in es)
    assert closed(edges) > 2 * closed(generators.power_law_cluster(n, m, 0.0, seed)) and max(map(len, near.values())) > 3 * m
    with pytest.raises(ValueError):
        generators.power_law_cluster(3, 3, 0.1, seed)


@pytest.mark.parametrize("seed", range(8))
def test_bundled_stars(seed):
    edges, centres, n = generators.bundled_stars(seed)
    near = cycles.neighbours(edges)
    first, last = n - 2, n - 1
    assert len(near) == n and len(centres) == 10 and len(edges) == len(set(map(frozenset, edges)))
    assert len(near[first]) == len(near[last]) == 5 and near[first] | near[last] <= set(centres)
    leaves = {v for v in near if v not in centres and v < first}
    assert all(len(near[v]) == 1 for v in leaves) and 30 * 10 <= n - 2 <= 50 * 10
    # Five chains of all centres: n - 2 - 10 leaves, 10 centres with 5 links less, 10 ends.
    assert len(edges) == (n - 2 - 10) + (10 - 5) + 10
    more, same, k = generators.bundled_stars_with_paths(seed)
    grown = cycles.neighbours(more)
    base = generators.bundled_stars(seed, low=10, high=30)
    assert same == base[1] and len(grown) == k and 5 * 5 <= k - base[2] <= 5 * 10
    new = [v for v in grown if v >= base[2]]
    ends = [v for v in new if grown[v] & set(same)]
    assert len(ends) == 10 and all(1 <= len(grown[v] & set(same)) <= 3 for v in ends) and policies.reached(grown, [0]) == set(grown)


def test_reports(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "score double")
    sols = spark.createDataFrame([(1, 1, 8), (1, 0, 7), (2, 0, 5)], "graph_id long, pos long, id long")
    curves = spark.createDataFrame([(1, 1, 0.25), (1, 0, 1.0), (2, 0, 0.5)], "graph_id long, k long, cnr double")
    graph_files.write_report(graph_files.report(rows([0.1, 0.3]), rows([0.5]), rows([0.0, 1.0]), sols, curves), f"{tmp_path}/report")
    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/report/part*")))
    assert text.split("\n") == ["20.00±10.00, CNR: 50.00±0.00, diff = 50.00±50.00", "7, 8, ", "5, ", "", "cnr=1.00, cnr=0.25, ", "cnr=0.50, ", ""]
    graph_files.write_scores(spark.createDataFrame([("b", 0.5, 2.0), ("a", 0.25, 1.0)], "dataset string, solution double, time double"), f"{tmp_path}/scores")
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/scores/part*"))
    assert text == "a,b\n0.25,0.5\n1.0,2.0\n"
    (tmp_path / "t0.csv").write_text("x,y\n1.5,2\n3,4\n")
    assert [r.time for r in graph_files.read_first_times(spark, f"{tmp_path}/t0.csv").collect()] == [1.5]


def test_lazy_greedy():
    rng = random.Random(1)
    for _ in range(60):
        size = {p: rng.randrange(1, 6) for p in range(12)}
        parts = {v: rng.sample(range(12), rng.randrange(0, 4)) for v in range(20)}
        taken, want = set(), []
        while True:
            gains = {v: sum(size[p] for p in ps if p not in taken) for v, ps in parts.items()}
            v = min(gains, key=lambda x: (-gains[x], x))
            if not gains[v]:
                break
            want.append((v, gains[v]))
            taken |= set(parts[v])
        got = cascade.lazy_greedy(parts, size)
        assert [x for x in got if x[1]] == want and cascade.lazy_greedy(parts, size, 2)[: len(want)] == want[:2]


def test_evaluate_solution(spark):
    ring = [(3, i, min(i, (i + 1) % 6), max(i, (i + 1) % 6)) for i in range(6)]
    edges = spark.createDataFrame(ring, "graph_id long, edge_id long, src long, dst long")
    vertices = spark.createDataFrame([(3, i) for i in range(6)], "graph_id long, id long")
    counts = spark.createDataFrame([(3, 6)], "graph_id long, n long")
    sol = spark.createDataFrame([(3, 0, 3), (3, 1, 0)], "graph_id long, pos long, id long")
    scores, curve = policies.evaluate_solution(edges, sol, vertices, counts)
    got = [(r.k, r.pairs) for r in curve.orderBy("k").collect()]
    order = [3, 0, 1, 2, 4, 5]
    assert got == list(enumerate(map(int, robustness.curve_of(order, [(u, v) for _, _, u, v in ring]))))
    assert abs(scores.first().robustness - sum(p for _, p in got[1:]) / 15 / 6) < 1e-12
    # Put back by rank: the last put back goes first, and the rest follow by id.
    _, again = policies.evaluate_solution(edges, sol, vertices, counts, 2, 0.2)
    order = policies.reinsertion(cycles.neighbours((u, v) for _, _, u, v in ring), [3, 0], "rank", 1)
    order += [v for v in range(6) if v not in order]
    assert [r.pairs for r in again.orderBy("k").collect()] == list(map(int, robustness.curve_of(order, [(u, v) for _, _, u, v in ring])))
    with pytest.raises(ValueError):
        policies.evaluate_solution(edges, sol, vertices, counts, 9)
    assert collections.Counter(order) == collections.Counter(range(6))
