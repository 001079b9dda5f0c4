"""Components by contraction: rounds over joins and the bounded end, against union-find."""

import random

import pytest

from test_forest import EDGES, some_graphs
from unravel.operators import components as comp, cycles, forest, robustness


@pytest.mark.parametrize("few", [5, 10_000])
def test_contraction(spark, monkeypatch, few):
    monkeypatch.setattr(comp, "FEW", few)
    rng = random.Random(5)
    rows = [(g, rng.randrange(300), rng.randrange(300)) for g in (1, 2) for _ in range(220)] + [(3, i, i + 1) for i in range(99)]
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long")
    ids = spark.createDataFrame([(g, i) for g in (1, 2, 3) for i in range(300)], "graph_id long, id long")
    sets = {g: robustness.UnionFind(300) for g in (1, 2, 3)}
    for g, u, v in rows:
        sets[g].join(u, v)
    least = {}
    for g in sets:
        for i in range(300):
            least.setdefault((g, sets[g].find(i)), i)
    want = {(g, i): least[g, sets[g].find(i)] for g in sets for i in range(300)}
    assert {(r.graph_id, r.id): r.comp for r in comp.components(ids, edges).collect()} == want


def test_tables_written_shrink(spark, monkeypatch):
    """All rounds together write no more than a few rows a vertex (labels were written whole
    in every round before: 16 rows a vertex here)."""
    monkeypatch.setattr(comp, "FEW", 50)
    made, cut = [], comp.cut
    monkeypatch.setattr(comp, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(comp, "drop", lambda df: None)
    n = 3000
    ids = spark.createDataFrame([(1, i) for i in range(n)], "graph_id long, id long")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)], "graph_id long, src long, dst long")
    assert comp.components(ids, edges).where("comp <> 0").count() == 0
    assert sum(t.count() for t in made) < 8 * n


@pytest.mark.parametrize("few", [2, 10_000])
def test_bridges_by_contraction(spark, monkeypatch, few):
    monkeypatch.setattr(forest, "FEW", few)
    rows = some_graphs(4)
    edges = spark.createDataFrame(rows, EDGES)
    want = {(r.graph_id, r.src, r.dst) for r in cycles.bridges(edges).collect()}
    assert {(r.graph_id, r.src, r.dst) for r in forest.bridges(edges).collect()} == want
