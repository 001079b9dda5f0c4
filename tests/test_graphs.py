"""Hand goldens and laws of the graph operators."""

import random

import pytest
from pyspark.sql import functions as F

from unravel.operators import batch, components as comp, cycles, matrix, policies, replay, residual, robustness
from unravel.plans.derive import Pool
from unravel.sources import generators as gen, graph_files as files

GOLDEN = {  # edges; degrees; wedges; pairs; vertices on cycles; 2-core; bridges
    "path": ([(0, 1), (1, 2), (2, 3)], [1, 2, 2, 1], 2, 6, set(), set(), 3),
    "cycle": ([(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], [2] * 5, 5, 10, set(range(5)), set(range(5)), 0),
    "star": ([(0, i) for i in range(1, 5)], [4, 1, 1, 1, 1], 6, 10, set(), set(), 4),
    "bowtie": ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)], [2, 2, 4, 2, 2], 10, 10, set(range(5)), set(range(5)), 0),
    "barbell": ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], [2, 2, 3, 3, 2, 2], 10, 15, set(range(6)), set(range(6)), 1),
    "dumbbell": ([(0, 1), (1, 2), (0, 2), (2, 6), (3, 6), (3, 4), (4, 5), (3, 5)], [2, 2, 3, 3, 2, 2, 2], 11, 21, set(range(6)), set(range(7)), 2),
    "k4": ([(a, b) for a in range(4) for b in range(a + 1, 4)], [3] * 4, 12, 6, set(range(4)), set(range(4)), 0),
}


@pytest.fixture(scope="module")
def pool(spark):
    parts = [files.graph_from_arrays(spark, g, [a for a, _ in e], [b for _, b in e], [0.5] * len(e)) for g, (e, *_) in enumerate(GOLDEN.values())]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.union(p)
    return Pool(edges.cache())


def by_graph(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.graph_id, []).append(tuple(r[c] for c in cols))
    return out


def test_goldens(pool):
    degrees = by_graph(pool.degrees, "id", "degree")
    wedges = dict(residual.wedge_counts(pool.edges).collect())
    labels = comp.components(pool.vertices, pool.edges)
    pairs = {r.graph_id: (r.pairs, r.components) for r in comp.connectivity(labels).collect()}
    on, core, cut_edges = (by_graph(x, "id") for x in (cycles.cycle_vertices(pool.edges), cycles.two_core(pool.edges), cycles.bridges(pool.edges).withColumn("id", F.col("src"))))
    for g, (_, d, w, p, c, k, b) in enumerate(GOLDEN.values()):
        assert [x for _, x in sorted(degrees[g])] == d
        assert wedges[g] == w
        assert pairs[g] == (p, 1)
        assert {x for (x,) in on.get(g, [])} == c
        assert {x for (x,) in core.get(g, [])} == k
        assert len(cut_edges.get(g, [])) == b


def test_path_robustness(pool, spark):
    order = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 0, 2), (0, 3, 3)], "graph_id long, id long, pos long")
    edges = pool.edges.where("graph_id = 0")
    full = robustness.robustness_curve(order, edges, pool.counts.where("graph_id = 0"))
    assert [r.conn for r in full.orderBy("k").collect()] == pytest.approx([1, 1 / 6, 0, 0])
    assert robustness.robustness_score(full, pool.counts).first().robustness == pytest.approx(1 / 24)


def test_curves_agree(pool):
    counts = pool.counts
    full = {(r.graph_id, r.k): r.pairs for r in robustness.robustness_curve(pool.solution, pool.edges, counts).collect()}
    some = robustness.checkpointed_curve(pool.solution, pool.edges, counts, 3).collect()
    assert some and all(full[r.graph_id, r.k] == r.pairs for r in some)


def test_matrix_laws(pool):
    rows = matrix.laplacian(pool.arcs).groupBy("graph_id", "row").agg(F.sum("value").alias("s"))
    assert all(r.s == 0 for r in rows.collect())
    rows = matrix.node_to_node(pool.arcs, "mean").groupBy("graph_id", "row").agg(F.sum("value").alias("s"))
    assert all(r.s == pytest.approx(1) for r in rows.collect())
    gcn = {(r.graph_id, r.row, r.col): r.value for r in matrix.node_to_node(pool.arcs, "gcn").collect()}
    assert all(gcn[g, b, a] == pytest.approx(x) for (g, a, b), x in gcn.items())
    walks = matrix.edge_to_edge(residual.symmetric_edges(pool.edges)).count()
    assert walks == sum(d * (d - 1) for _, ds, *_ in GOLDEN.values() for d in ds)
    with pytest.raises(ValueError):
        matrix.node_to_node(pool.arcs, "other")


def test_betweenness():
    score = lambda name: policies.betweenness_scores(cycles.neighbours(GOLDEN[name][0]))
    assert [score("path")[i] for i in range(4)] == pytest.approx([0, 2 / 3, 2 / 3, 0])
    assert score("star")[0] == pytest.approx(1) and score("star")[1] == 0
    assert list(score("cycle").values()) == pytest.approx([1 / 6] * 5)


def test_bridges_by_brute_force():
    draw = random.Random(4)
    for _ in range(30):
        pairs = {tuple(sorted(draw.sample(range(12), 2))) for _ in range(14)}

        def joined(edges, a, b):
            seen, todo = {a}, [a]
            near = cycles.neighbours(edges)
            while todo:
                for w in near.get(todo.pop(), ()):
                    if w not in seen:
                        seen.add(w)
                        todo.append(w)
            return b in seen

        assert cycles.bridge_pairs(cycles.neighbours(pairs)) == {e for e in pairs if not joined(pairs - {e}, *e)}
        left = cycles.neighbours(pairs)
        for v in cycles.break_cycles(left):
            for w in left.pop(v):
                left[w].discard(v)
        assert not cycles.cyclic(left)


def test_adaptive_and_reinsertion():
    near = cycles.neighbours(GOLDEN["bowtie"][0])
    for name in ("degree", "betweenness", "closeness", "pagerank"):
        assert policies.adaptive(near, policies.SCORES[name], 1) == [2]
    assert cycles.break_cycles(near) == [2]
    path = cycles.neighbours(GOLDEN["path"][0])
    # All score 1: 0 goes back; then 2 (1), 3 (2), 1 (4); the last is removed first.
    assert policies.reinsertion(path, [1, 2, 0, 3], "rank", 1) == [1, 3, 2, 0]
    with pytest.raises(ValueError):
        policies.reinsertion(path, [1], "rank", 0)


def test_empty_and_isolated(spark):
    none = spark.createDataFrame([], "graph_id long, edge_id long, src long, dst long, value double")
    p = Pool(none)
    assert p.vertices.count() == 0
    v = spark.createDataFrame([(1, 5)], "graph_id long, id long")
    labels = comp.components(v, none)
    row = comp.connectivity(labels).first()
    assert (row.largest, row.pairs, row.components) == (1, 0, 1)
    rem = spark.createDataFrame([(1, 5, 0), (1, 5, 0)], "graph_id long, id long, step long")
    s = residual.status(v, none, rem).first()
    assert (s.n, s.removed, s.available, s.covered_frac, s.edges) == (1, 1, 0, 2.0, 0)


def test_batch_raises_on_removed_action(pool, spark):
    request = spark.createDataFrame([(0, 0)], "batch_pos long, graph_id long")
    gone = spark.createDataFrame([(0, 1)], "batch_pos long, id long")
    labels = batch.relabel(request, pool.vertices, gone)
    assert [r.global_id for r in labels.orderBy("id").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="not a residual vertex"):
        batch.select_actions(gone, labels).collect()


def test_sum_tree_and_nstep(spark):
    slots = spark.createDataFrame([(i, 1.0) for i in range(5)], "slot long, priority double")
    order = [r.slot for r in replay.cumulative(slots, 5).orderBy("hi").collect()]
    assert order == [3, 4, 0, 1, 2]
    assert [r.slot for r in replay.cumulative(spark.createDataFrame([(i, 1.0) for i in range(6)], "slot long, priority double"), 6).orderBy("hi").collect()] == [2, 3, 4, 5, 0, 1]
    steps = spark.createDataFrame([(0, i, i, float(i + 1)) for i in range(3)], "episode long, step long, action long, reward double")
    rows = replay.nstep(steps, 2).orderBy("step").collect()
    assert [(r.nstep_return, r.terminal) for r in rows] == [(3, False), (5, True), (3, True)]


def test_files(spark, tmp_path):
    (tmp_path / "g_7").write_text('graph [\n name "x(3,1)"\n node [\n id 0\n label "0"\n weight 0.5\n ]\n node [\n id 1\n label 1\n ]\n edge [\n source 1\n target 0\n weight 0.25\n ]\n]\n')
    v, e = files.read_gml(spark, str(tmp_path / "g_7"))
    assert sorted(tuple(r) for r in v.collect()) == [(7, 0, "0", 0.5), (7, 1, "1", None)]
    assert [tuple(r) for r in e.collect()] == [(7, 0, 0, 1, 0.25)]
    edges = gen.graph(spark, 1, gen.preferential(40, 4, 1))
    assert edges.count() == 4 * 36
    files.write_edge_list(edges, str(tmp_path / "list"))
    assert files.read_edge_list(spark, str(tmp_path / "list")).exceptAll(edges.select("src", "dst")).count() == 0
    (tmp_path / "curve").write_text("1.0\n5, 0.5\n3, 0.25\n")
    assert [tuple(r)[1:] for r in files.read_curves(spark, str(tmp_path / "curve")).orderBy("pos").collect()] == [(0, None, 1.0), (1, "5", 0.5), (2, "3", 0.25)]
    (tmp_path / "times.csv").write_text("a,b\n1.5,2\n")
    assert sorted(tuple(r)[1:] for r in files.read_timings(spark, str(tmp_path / "times.csv")).collect()) == [("a", 1.5), ("b", 2.0)]
    assert len(gen.star_chain()) == 89 and len(gen.small_world(20, 4, 0.5, 1)) == 40 and gen.uniform_pairs(10, 1.0, 0)[-1] == (8, 9)
