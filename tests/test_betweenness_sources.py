"""Betweenness with a graph's sources dealt over tasks."""

from test_forest import EDGES, some_graphs
from unravel.operators import betweenness, policies


def test_by_sources(spark):
    edges = spark.createDataFrame(some_graphs(7), EDGES)
    want = {(r.graph_id, r.id): round(r.score, 9) for r in policies.centrality(edges, "betweenness").collect()}
    assert {(r.graph_id, r.id): round(r.score, 9) for r in betweenness.by_sources(edges, 7).collect()} == want


def test_components_apart(spark):
    """Components dealt to shares, of which some are searched by several tasks; loops and repeated rows count for nothing."""
    rows = [(g, u, v) for g, _, u, v in some_graphs(11)]
    rows += [(9, 10 * k + a, 10 * k + b) for k in range(30) for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (1, 5))]
    rows += [(9, 1000 + k, 1000 + (k + 1) % 40) for k in range(40)] + [(10, 1, 2)]
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long")
    want = {(r.graph_id, r.id): round(r.score, 9) for r in policies.centrality(edges, "betweenness").collect()}
    for each, share in ((7, 20), (100, 1)):
        got = betweenness.by_sources(edges.union(edges.limit(5)), each, share_edges=share).collect()
        assert len(got) == len(want) and {(r.graph_id, r.id): round(r.score, 9) for r in got} == want
    loop = spark.createDataFrame([(1, 4, 4), (1, 4, 5), (1, 6, 6)], "graph_id long, src long, dst long")
    assert {(r.id, r.score) for r in betweenness.by_sources(loop).collect()} == {(4, 0.0), (5, 0.0), (6, 0.0)}
