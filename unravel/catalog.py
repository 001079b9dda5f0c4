"""Queries by name and their SQL.

All run on the derived pool of graphs (``plans.derive.order_pool``), on episodes
made of ``events``, or on curves made of them, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .operators import batch, betweenness, cascade, components as comp, cycles, decycling, forest, matrix, metrics, policies, pool as pools, replay, residual, robustness
from .plans.derive import Pool, cut, order_pool, trade_pool

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "residual_status"
SIMS, CAPACITY, STEPS = 3, 1000, 3
METHODS = ["click", "error", "purchase", "signup", "view"]

POOL_SQL = """lines AS (SELECT DISTINCT l_orderkey k, l_partkey p FROM lineitem WHERE l_quantity >= 40),
pairs AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) graph_id, a.p src, b.p dst FROM lines a JOIN lines b ON a.k = b.k AND a.p < b.p JOIN orders ON o_orderkey = a.k),
edges AS (SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS BIGINT) edge_id, src, dst, CAST((src * 7919 + dst * 104729) % 1000 AS DOUBLE) / 1000.0 AS value FROM pairs),
arcs AS (SELECT graph_id, src, dst, edge_id, value FROM edges UNION ALL SELECT graph_id, dst, src, edge_id, value FROM edges),
deg AS (SELECT graph_id, src id, CAST(count(*) AS BIGINT) degree FROM arcs GROUP BY 1, 2),
v AS (SELECT graph_id, id FROM deg),
counts AS (SELECT graph_id, CAST(count(*) AS BIGINT) n, CAST(sum(degree) / 2 AS BIGINT) m FROM deg GROUP BY 1),
sol AS (SELECT graph_id, id, degree, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, id) - 1 AS BIGINT) pos FROM deg),
rem AS (SELECT graph_id, id, pos step FROM sol JOIN counts USING (graph_id) WHERE pos * 10 < n),
res AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM rem r WHERE r.graph_id = e.graph_id AND r.id IN (e.src, e.dst))),
resv AS (SELECT graph_id, id FROM v WHERE (graph_id, id) NOT IN (SELECT (graph_id, id) FROM rem)),
sym AS (SELECT graph_id, 2 * edge_id + d AS arc_id, CASE d WHEN 0 THEN src ELSE dst END src, CASE d WHEN 0 THEN dst ELSE src END dst FROM edges, (VALUES (0), (1)) t(d))"""
STEPS_SQL = """steps AS (SELECT user_id episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) step, event_id AS action, value reward, event_type FROM events)"""
CURVES_SQL = """curves AS (SELECT event_type AS method, user_id graph_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS BIGINT) pos, abs(value) AS cnr FROM events)"""


def reach_sql(name: str, arcs: str, vertices: str, keys: str = "graph_id") -> str:
    """CTEs: ``name`` (keys, id, comp), the least id that each vertex reaches."""
    on = " AND ".join(f"r.{k} = a.{k}" for k in keys.split(", "))
    return f"""{name}_r AS (SELECT {keys}, id, id AS seen FROM {vertices} UNION SELECT {", ".join("r." + k for k in keys.split(", "))}, r.id, a.dst FROM {name}_r r JOIN {arcs} a ON {on} AND a.src = r.seen),
{name} AS (SELECT {keys}, id, min(seen) AS comp FROM {name}_r GROUP BY {keys}, id)"""


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a function of (spark, sf_dir) and its SQL under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = (f"WITH RECURSIVE {', '.join(ctes)}\n" if ctes else "") + sql
        return fn

    return add


def pooled(name: str, sql: str | None = None, *ctes: str, loops: bool = False):
    """A query that is a function of the pool; ``loops``: its edges are cut first."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pool = order_pool(spark, sf_dir)
            return fn(Pool(cut(pool.edges)) if loops else pool)

        query(name, sql, *([POOL_SQL, *ctes] if sql else []))(run)
        return fn

    return add


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: episode (user), step by time, action (event), reward."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("episode"), (F.row_number().over(w) - 1).cast("long").alias("step"), F.col("event_id").alias("action"), F.col("value").alias("reward"), "event_type")


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as curves: method (type), graph (user), pos by time, cnr."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("method"), F.col("user_id").alias("graph_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.abs("value").alias("cnr"))


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in names})


# Graphs
pooled("graph_edges", "SELECT graph_id, edge_id, src, dst, value FROM edges")(lambda p: p.edges)
pooled("graph_vertices", "SELECT graph_id, id FROM v")(lambda p: p.vertices)
pooled("edges_symmetric", "SELECT graph_id, arc_id, src, dst FROM sym")(lambda p: residual.symmetric_edges(p.edges))
pooled("adjacency_sorted", "SELECT graph_id, src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM arcs GROUP BY 1, 2")(lambda p: residual.adjacency(p.arcs).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ",")))
pooled("degree", "SELECT graph_id, id, degree FROM deg")(lambda p: p.degrees)
pooled("degree_histogram", "SELECT graph_id, degree, CAST(count(*) AS BIGINT) vertices FROM deg GROUP BY 1, 2")(lambda p: metrics.degree_histogram(p.degrees))
pooled("degree_share_weight", "SELECT graph_id, id, round(100.0 * degree / sum(degree) OVER (PARTITION BY graph_id), 6) AS share FROM deg")(lambda p: rounded(metrics.degree_shares(p.degrees).select("graph_id", "id", "share"), "share"))
pooled("degree_cost_weight", "SELECT graph_id, id, round(degree / max(degree) OVER (PARTITION BY graph_id), 6) AS cost FROM deg")(lambda p: rounded(metrics.degree_shares(p.degrees).select("graph_id", "id", "cost"), "cost"))

BINS_SQL = """SELECT e.graph_id, b AS bin, round(lo + b * span / 10, 6) AS low, CAST(coalesce(c.k, 0) AS BIGINT) AS vertices, round(coalesce(c.k, 0) * 10 / span / n, 6) AS density
FROM ends e CROSS JOIN (SELECT CAST(i AS BIGINT) b FROM range(0, 10) t(i)) LEFT JOIN (SELECT graph_id, least(CAST(floor((degree - lo) * 10 / span) AS BIGINT), 9) b, count(*) k FROM deg JOIN ends USING (graph_id) GROUP BY 1, 2) c USING (graph_id, b)"""
pooled("degree_density_bins", BINS_SQL, "ends AS (SELECT graph_id, count(*) n, CASE WHEN min(degree) = max(degree) THEN min(degree) - 0.5 ELSE CAST(min(degree) AS DOUBLE) END lo, CASE WHEN min(degree) = max(degree) THEN 1.0 ELSE CAST(max(degree) - min(degree) AS DOUBLE) END span FROM deg GROUP BY 1)")(lambda p: rounded(metrics.degree_bins(p.degrees), "low", "density"))
pooled("degree_range", "SELECT graph_id, min(degree) AS least, max(degree) AS most FROM deg GROUP BY 1")(lambda p: p.degrees.groupBy("graph_id").agg(F.min("degree").alias("least"), F.max("degree").alias("most")))


def two_solutions(p: Pool) -> DataFrame:
    """method, graph_id, pos, id: the first tenth by degree, and every 15th vertex by id."""
    w = Window.partitionBy("graph_id").orderBy("id")
    other = p.vertices.where("id % 15 = 0").withColumn("pos", F.row_number().over(w).cast("long") - 1)
    return p.removals.select(F.lit("degree").alias("method"), "graph_id", F.col("step").alias("pos"), "id").union(other.select(F.lit("id"), "graph_id", "pos", "id"))


TWO_SQL = """two AS (SELECT 'degree' AS method, graph_id, step AS pos, id FROM rem UNION ALL SELECT 'id', graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY id) - 1, id FROM v WHERE id % 15 = 0),
cut60 AS (SELECT graph_id, CAST(floor(min(l) * 0.6) AS BIGINT) k FROM (SELECT graph_id, method, count(*) l FROM two GROUP BY 1, 2) GROUP BY 1)"""
pooled("residual_at_share", "SELECT m.method, e.graph_id, e.src, e.dst FROM edges e CROSS JOIN (SELECT DISTINCT method FROM two) m WHERE NOT EXISTS (SELECT 1 FROM two t JOIN cut60 c USING (graph_id) WHERE t.pos < c.k AND t.method = m.method AND t.graph_id = e.graph_id AND t.id IN (e.src, e.dst))", TWO_SQL)(
    lambda p: (lambda gone: residual.residual_edges(p.edges, gone.where("method = 'degree'")).select(F.lit("degree").alias("method"), "graph_id", "src", "dst").union(residual.residual_edges(p.edges, gone.where("method = 'id'")).select(F.lit("id"), "graph_id", "src", "dst")))(metrics.shortest_share(two_solutions(p)))
)

# Residual graphs
pooled("residual_edges", "SELECT graph_id, edge_id, src, dst, value FROM res")(lambda p: residual.residual_edges(p.edges, p.removals))
pooled("residual_vertices", "SELECT graph_id, id FROM resv")(lambda p: residual.residual_vertices(p.vertices, p.removals))
pooled("idx_map", "SELECT v.graph_id, v.id, CAST(CASE WHEN r.id IS NULL THEN 0 ELSE -1 END AS BIGINT) AS idx FROM v LEFT JOIN rem r USING (graph_id, id)")(lambda p: residual.removal_flags(p.vertices, p.removals))
STATUS_SQL = """SELECT c.graph_id, n, CAST(r.removed AS BIGINT) removed, CAST(n - r.removed AS BIGINT) available, m AS edges, CAST(m - k.kept AS BIGINT) removed_edges, CAST(w.wedges AS BIGINT) wedges, CAST(0 AS BIGINT) three_hop,
round(r.removed / CAST(n AS DOUBLE), 6) covered_frac, CAST(1.0 AS DOUBLE) bias, round((m - k.kept) / CAST(m AS DOUBLE), 6) edge_frac, round(w.wedges / CAST(n * n AS DOUBLE), 6) wedge_density
FROM counts c JOIN (SELECT graph_id, count(*) removed FROM rem GROUP BY 1) r USING (graph_id) JOIN (SELECT graph_id, count(*) kept FROM res GROUP BY 1) k USING (graph_id)
JOIN (SELECT graph_id, sum(d * (d - 1)) / 2 wedges FROM (SELECT graph_id, id, count(*) d FROM (SELECT graph_id, src id FROM res UNION ALL SELECT graph_id, dst FROM res) GROUP BY 1, 2) GROUP BY 1) w USING (graph_id)"""
pooled("residual_status", STATUS_SQL)(lambda p: rounded(residual.status(p.vertices, p.edges, p.removals), "covered_frac", "edge_frac", "wedge_density"))
pooled("common_neighbor_pairs", "SELECT graph_id, CAST(count(*) AS BIGINT) pairs FROM (SELECT DISTINCT a.graph_id, a.dst x, b.dst y FROM arcs a JOIN arcs b ON a.graph_id = b.graph_id AND a.src = b.src AND a.dst < b.dst WHERE (a.graph_id, a.dst) IN (SELECT (graph_id, id) FROM resv) AND (b.graph_id, b.dst) IN (SELECT (graph_id, id) FROM resv)) GROUP BY 1")(lambda p: residual.common_neighbor_pairs(p.arcs, p.vertices, p.removals))
pooled("touched_edges", "SELECT graph_id, string_agg(CAST(edge_id AS VARCHAR), ',' ORDER BY edge_id) AS edges FROM (SELECT DISTINCT e.graph_id, e.edge_id FROM edges e JOIN rem r ON r.graph_id = e.graph_id AND r.id IN (e.src, e.dst)) GROUP BY 1")(lambda p: residual.touched_edges(p.arcs, p.removals).withColumn("edges", F.array_join(F.col("edges").cast("array<string>"), ",")))
pooled("sym_diff_vertices", "SELECT graph_id, id FROM resv")(lambda p: residual.symmetric_difference(p.vertices, p.removals))
pooled("topk_removals", "SELECT graph_id, pos, id FROM sol WHERE pos < 10")(lambda p: p.solution.where("pos < 10").select("graph_id", "pos", "id"))

# Matrices
pooled("n2n_sum", "SELECT graph_id, src AS row, dst AS col, CAST(1.0 AS DOUBLE) AS value FROM arcs")(lambda p: matrix.node_to_node(p.arcs))
pooled("n2n_mean", "SELECT a.graph_id, src AS row, dst AS col, round(1.0 / CAST(degree AS DOUBLE), 6) AS value FROM arcs a JOIN deg d ON a.graph_id = d.graph_id AND a.src = d.id")(lambda p: rounded(matrix.node_to_node(p.arcs, "mean"), "value"))
pooled("n2n_gcn", "SELECT a.graph_id, src AS row, dst AS col, round(1.0 / sqrt((d.degree + 1.0) * (e.degree + 1.0)), 6) AS value FROM arcs a JOIN deg d ON a.graph_id = d.graph_id AND a.src = d.id JOIN deg e ON a.graph_id = e.graph_id AND a.dst = e.id")(lambda p: rounded(matrix.node_to_node(p.arcs, "gcn"), "value"))
pooled("n2n_weighted", "SELECT graph_id, src AS row, dst AS col, round(sum(value), 6) AS value FROM arcs GROUP BY 1, 2, 3")(lambda p: rounded(matrix.weighted(p.arcs), "value"))
pooled("laplacian", "SELECT graph_id, id AS row, id AS col, CAST(degree AS DOUBLE) AS value FROM deg UNION ALL SELECT graph_id, src, dst, CAST(-1.0 AS DOUBLE) FROM arcs")(lambda p: matrix.laplacian(p.arcs))
pooled("e2n", "SELECT graph_id, dst AS row, arc_id AS col, CAST(1.0 AS DOUBLE) AS value FROM sym")(lambda p: matrix.edge_to_node(residual.symmetric_edges(p.edges)))
pooled("n2e", "SELECT graph_id, arc_id AS row, src AS col, CAST(1.0 AS DOUBLE) AS value FROM sym")(lambda p: matrix.node_to_edge(residual.symmetric_edges(p.edges)))
pooled("e2e_nonbacktracking", "SELECT a.graph_id, a.arc_id AS row, b.arc_id AS col, CAST(1.0 AS DOUBLE) AS value FROM sym a JOIN sym b ON a.graph_id = b.graph_id AND b.dst = a.src AND b.src <> a.dst")(lambda p: matrix.edge_to_edge(residual.symmetric_edges(p.edges)))

pooled("laplacian_weighted", "SELECT graph_id, src AS row, src AS col, round(sum(value), 6) AS value FROM arcs GROUP BY 1, 2, 3 UNION ALL SELECT graph_id, src, dst, round(-value, 6) FROM arcs")(lambda p: rounded(matrix.weighted_laplacian(p.arcs), "value"))
VALUED_SQL = "symv AS (SELECT s.graph_id, arc_id, s.src, s.dst, e.value FROM sym s JOIN edges e ON e.graph_id = s.graph_id AND e.src = least(s.src, s.dst) AND e.dst = greatest(s.src, s.dst))"


def valued_arcs(p: Pool) -> DataFrame:
    ends = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("w")]
    return residual.symmetric_edges(p.edges).select("*", *ends).join(p.edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("w"), "value"), ["graph_id", "u", "w"])


pooled("e2n_weighted", "SELECT graph_id, dst AS row, arc_id AS col, value FROM symv", VALUED_SQL)(lambda p: matrix.weighted_edge_to_node(valued_arcs(p)))
pooled("n2e_weighted", "SELECT graph_id, arc_id AS row, src AS col, value FROM symv", VALUED_SQL)(lambda p: matrix.weighted_node_to_edge(valued_arcs(p)))

# Batches: graphs 1, 2, 1 and one whose vertices are all removed.
REQUEST = [(0, 1), (1, 2), (2, 1), (3, 3)]
BATCH_SQL = """request AS (SELECT CAST(b AS BIGINT) batch_pos, CAST(g AS BIGINT) graph_id FROM (VALUES (0, 1), (1, 2), (2, 1), (3, 3)) t(b, g)),
brem AS (SELECT batch_pos, id FROM request JOIN rem USING (graph_id) WHERE batch_pos < 3 UNION SELECT batch_pos, id FROM request JOIN v USING (graph_id) WHERE batch_pos = 3),
labels AS (SELECT batch_pos, q.graph_id, v.id, CAST(row_number() OVER (ORDER BY batch_pos, v.id) - 1 AS BIGINT) global_id FROM request q JOIN v USING (graph_id) WHERE (batch_pos, v.id) NOT IN (SELECT (batch_pos, id) FROM brem))"""


def batch_parts(p: Pool) -> tuple[DataFrame, DataFrame]:
    """(request, labels) of the fixed batch."""
    request = p.edges.sparkSession.createDataFrame(REQUEST, "batch_pos long, graph_id long")
    some = request.where("batch_pos < 3").join(p.removals, "graph_id").select("batch_pos", "id")
    gone = some.union(request.where("batch_pos = 3").join(p.vertices, "graph_id").select("batch_pos", "id"))
    return request, batch.relabel(request, p.vertices, gone)


pooled("batch_relabel", "SELECT batch_pos, graph_id, id, global_id FROM labels", BATCH_SQL)(lambda p: batch_parts(p)[1])
pooled("batch_spans", "SELECT q.batch_pos, CAST(coalesce(min(global_id), (SELECT count(*) FROM labels)) AS BIGINT) AS first, CAST(coalesce(max(global_id), (SELECT count(*) FROM labels)) AS BIGINT) AS last FROM request q LEFT JOIN labels l USING (batch_pos) GROUP BY 1", BATCH_SQL)(lambda p: batch.spans(*batch_parts(p)))
pooled("batch_edges", "SELECT q.batch_pos, e.edge_id, s.global_id AS src, d.global_id AS dst FROM request q JOIN edges e USING (graph_id) JOIN labels s ON s.batch_pos = q.batch_pos AND s.id = e.src JOIN labels d ON d.batch_pos = q.batch_pos AND d.id = e.dst", BATCH_SQL)(lambda p: (lambda q, lab: batch.batch_edges(q, p.edges, lab))(*batch_parts(p)))
pooled("subgraph_membership", "SELECT batch_pos AS row, global_id AS col, CAST(1.0 AS DOUBLE) AS value FROM labels", BATCH_SQL)(lambda p: batch.membership(batch_parts(p)[1]))
pooled("rep_global", "SELECT global_id AS row, batch_pos AS col, CAST(1.0 AS DOUBLE) AS value FROM labels", BATCH_SQL)(lambda p: batch.transpose(batch.membership(batch_parts(p)[1])))
pooled("act_select", "SELECT batch_pos AS row, min(global_id) AS col, CAST(1.0 AS DOUBLE) AS value FROM labels GROUP BY 1", BATCH_SQL)(lambda p: (lambda lab: batch.select_actions(lab.groupBy("batch_pos").agg(F.min("id").alias("id")), lab))(batch_parts(p)[1]))
BATCH_ARCS_SQL = (BATCH_SQL, "bedges AS (SELECT s.global_id AS src, d.global_id AS dst FROM request q JOIN edges e USING (graph_id) JOIN labels s ON s.batch_pos = q.batch_pos AND s.id = e.src JOIN labels d ON d.batch_pos = q.batch_pos AND d.id = e.dst), barcs AS (SELECT src, dst FROM bedges UNION ALL SELECT dst, src FROM bedges)")


def batch_setup(p: Pool) -> dict[str, DataFrame]:
    """The fixed batch, made for training on the least vertex of each graph."""
    request, labels = batch_parts(p)
    some = request.where("batch_pos < 3").join(p.removals, "graph_id").select("batch_pos", "id")
    gone = some.union(request.where("batch_pos = 3").join(p.vertices, "graph_id").select("batch_pos", "id"))
    return batch.setup(request, p.vertices, p.edges, gone, labels.groupBy("batch_pos").agg(F.min("id").alias("id")), "mean")


pooled("batch_setup_n2n", "SELECT a.src AS row, a.dst AS col, round(1.0 / d, 6) AS value FROM barcs a JOIN (SELECT src, CAST(count(*) AS DOUBLE) d FROM barcs GROUP BY 1) c ON c.src = a.src", *BATCH_ARCS_SQL)(lambda p: rounded(batch_setup(p)["n2n"], "value"))
pooled("batch_setup_laplacian", "SELECT src AS row, src AS col, CAST(count(*) AS DOUBLE) AS value FROM barcs GROUP BY 1 UNION ALL SELECT src, dst, CAST(-1.0 AS DOUBLE) FROM barcs", *BATCH_ARCS_SQL)(lambda p: batch_setup(p)["laplacian"])
pooled("masked_membership", "SELECT graph_id AS row, pos AS col, CAST(1.0 AS DOUBLE) AS value FROM sol WHERE degree >= 4")(lambda p: batch.masked_membership(p.solution.groupBy(F.col("graph_id").alias("batch_pos")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "degree"))), lambda x: (x["degree"] >= 4).cast("int")).alias("mask"))))

# Components
FULL = reach_sql("comps", "arcs", "v")
pooled("components", "SELECT graph_id, id, comp FROM comps", FULL, loops=True)(lambda p: comp.components(p.vertices, p.edges))
pooled("component_sizes", "SELECT graph_id, comp, CAST(count(*) AS BIGINT) AS size FROM comps GROUP BY 1, 2", FULL, loops=True)(lambda p: comp.component_sizes(comp.components(p.vertices, p.edges)))
pooled("pairwise_connectivity", "SELECT graph_id, CAST(sum(s) AS BIGINT) n, CAST(count(*) AS BIGINT) components, CAST(max(s) AS BIGINT) largest, CAST(sum(s * (s - 1)) / 2 AS BIGINT) pairs, round(max(s) / sum(s), 6) ratio FROM (SELECT graph_id, comp, count(*) s FROM comps GROUP BY 1, 2) GROUP BY 1", FULL, loops=True)(lambda p: rounded(comp.connectivity(comp.components(p.vertices, p.edges)), "ratio"))
RESC = ("rarcs AS (SELECT graph_id, src, dst FROM res UNION ALL SELECT graph_id, dst, src FROM res)", reach_sql("rcomps", "rarcs", "resv"))


def residual_components(p: Pool) -> DataFrame:
    return comp.components(residual.residual_vertices(p.vertices, p.removals), residual.residual_edges(p.edges, p.removals))


pooled("max_component", "SELECT graph_id, CAST(max(s) AS BIGINT) largest FROM (SELECT graph_id, comp, count(*) s FROM rcomps GROUP BY 1, 2) GROUP BY 1", *RESC, loops=True)(lambda p: comp.connectivity(residual_components(p)).select("graph_id", "largest"))
pooled("biggest_ratio", "SELECT graph_id, round(max(s) / sum(s), 6) ratio FROM (SELECT graph_id, comp, count(*) s FROM rcomps GROUP BY 1, 2) GROUP BY 1", *RESC, loops=True)(lambda p: rounded(comp.connectivity(residual_components(p)).select("graph_id", "ratio"), "ratio"))
pooled("residual_score", "SELECT graph_id, round(sum(s * (s - 1)) / 2 / (n * (n - 1) / 2.0), 6) score FROM (SELECT graph_id, comp, count(*) s FROM rcomps GROUP BY 1, 2) JOIN counts USING (graph_id) GROUP BY 1, n", *RESC, loops=True)(lambda p: rounded(comp.residual_score(residual_components(p), p.counts), "score"))
pooled("reinsert_scores", """SELECT r.graph_id, r.id, CAST(count(s.comp) AS BIGINT) AS "count", CAST(1 + coalesce(sum(s.size), 0) AS BIGINT) AS "rank", CAST(count(s.comp) * (1 + coalesce(sum(s.size), 0)) AS BIGINT) AS multiple
FROM rem r LEFT JOIN (SELECT DISTINCT a.graph_id, a.src id, c.comp FROM arcs a JOIN rcomps c ON a.graph_id = c.graph_id AND a.dst = c.id) t USING (graph_id, id) LEFT JOIN (SELECT graph_id, comp, count(*) size FROM rcomps GROUP BY 1, 2) s ON s.graph_id = t.graph_id AND s.comp = t.comp GROUP BY 1, 2""", *RESC, loops=True)(lambda p: policies.reinsert_scores(p.arcs, residual_components(p), p.removals))

# Robustness
CURVE_SQL = ("""placed AS (SELECT s.graph_id, s.id, s.pos, n, CAST(ceil(n / 10.0) AS BIGINT) st FROM sol s JOIN counts USING (graph_id)),
alive AS (SELECT graph_id, st * i AS k, id FROM placed, range(0, 11) t(i) WHERE st * i <= pos),
live AS (SELECT a.graph_id, k1.k, a.src, a.dst FROM arcs a JOIN alive k1 ON k1.graph_id = a.graph_id AND k1.id = a.src JOIN alive k2 ON k2.graph_id = a.graph_id AND k2.id = a.dst AND k1.k = k2.k)""", reach_sql("kc", "live", "alive", "graph_id, k"))
pooled("robustness_curve", "SELECT graph_id, k, CAST(sum(s * (s - 1)) / 2 AS BIGINT) pairs, round(sum(s * (s - 1)) / 2 / (n * (n - 1) / 2.0), 6) conn FROM (SELECT graph_id, k, comp, count(*) s FROM kc GROUP BY 1, 2, 3) JOIN counts USING (graph_id) GROUP BY 1, 2, n", *CURVE_SQL, loops=True)(lambda p: rounded(robustness.checkpointed_curve(p.solution, p.edges, p.counts), "conn"))
pooled("robustness_curve_full")(lambda p: rounded(robustness.robustness_curve(p.solution, p.edges, p.counts), "conn"))
pooled("robustness_curve_forest", loops=True)(lambda p: rounded(forest.curve(p.solution, p.edges, p.counts), "conn"))
pooled("robustness_score")(lambda p: robustness.robustness_score(robustness.robustness_curve(p.solution, p.edges, p.counts), p.counts))

# Cascades
LIVE_SQL = (f"""sims AS (SELECT CAST(s AS BIGINT) sim FROM range(0, {SIMS}) t(s)), sv AS (SELECT graph_id, sim, id FROM v, sims),
le AS (SELECT graph_id, sim, src, dst FROM edges, sims WHERE CAST((src * 31 + dst * 17 + sim * 7907) % 1000 AS DOUBLE) / 1000.0 < value), larcs AS (SELECT * FROM le UNION ALL SELECT graph_id, sim, dst, src FROM le)""", reach_sql("lc", "larcs", "sv", "graph_id, sim"), "hit AS (SELECT l.* FROM lc l WHERE (graph_id, sim, comp) IN (SELECT (c.graph_id, c.sim, c.comp) FROM lc c JOIN rem r ON r.graph_id = c.graph_id AND r.id = c.id))")
pooled("influence_spread", "SELECT graph_id, sim, CAST(count(*) AS BIGINT) spread FROM hit GROUP BY 1, 2", *LIVE_SQL, loops=True)(lambda p: cascade.spread(cascade.live_components(p.vertices, p.edges, SIMS), p.removals))
pooled("influence_spread_mc", f"SELECT graph_id, CAST(floor(count(*) / {SIMS}.0) AS DOUBLE) spread FROM hit GROUP BY 1", *LIVE_SQL, loops=True)(lambda p: cascade.mean_spread(cascade.live_components(p.vertices, p.edges, SIMS), p.removals, SIMS))
pooled("influence_candidates", "SELECT v.graph_id, v.id, CAST(CASE WHEN h.id IS NULL THEN 1 ELSE 0 END AS BIGINT) free FROM v LEFT JOIN (SELECT graph_id, id FROM hit WHERE sim = 0) h USING (graph_id, id)", *LIVE_SQL, loops=True)(lambda p: cascade.candidates(cascade.live_components(p.vertices, p.edges, 1), p.removals))
ACTION_SQL = "SELECT graph_id, id, CAST(gain AS BIGINT) AS gain FROM (SELECT graph_id, id, sum(size) AS gain, row_number() OVER (PARTITION BY graph_id ORDER BY sum(size) DESC, id) AS r FROM lc JOIN (SELECT graph_id, sim, comp, count(*) AS size FROM lc GROUP BY 1, 2, 3) USING (graph_id, sim, comp) GROUP BY 1, 2) WHERE r = 1"
pooled("influence_action", ACTION_SQL, *LIVE_SQL, loops=True)(lambda p: cascade.influence_action(cascade.live_components(p.vertices, p.edges, SIMS)))
pooled("influence_order", loops=True)(lambda p: cascade.influence_order(cascade.live_components(p.vertices, p.edges, SIMS)))
pooled("influence_robustness", f"""SELECT graph_id, round(sum(floor(grown / {SIMS}.0)) / n / n, 6) robustness FROM (SELECT s.graph_id, s.pos, sum(coalesce(f.size, 0)) OVER (PARTITION BY s.graph_id ORDER BY s.pos) grown FROM sol s LEFT JOIN (SELECT graph_id, pos, sum(size) size FROM (SELECT c.graph_id, c.sim, c.comp, min(s.pos) pos, count(*) size FROM lc c JOIN sol s ON s.graph_id = c.graph_id AND s.id = c.id GROUP BY 1, 2, 3) GROUP BY 1, 2) f USING (graph_id, pos)) JOIN counts USING (graph_id) GROUP BY graph_id, n""", *LIVE_SQL, loops=True)(lambda p: rounded(cascade.influence_robustness(cascade.live_components(p.vertices, p.edges, SIMS), p.solution, p.counts, SIMS), "robustness"))
pooled("influenced_one_round", "SELECT DISTINCT a.graph_id, a.dst AS id FROM arcs a JOIN rem r ON r.graph_id = a.graph_id AND r.id = a.src WHERE CAST((least(a.src, a.dst) * 31 + greatest(a.src, a.dst) * 17) % 1000 AS DOUBLE) / 1000.0 < a.value AND (a.graph_id, a.dst) NOT IN (SELECT (graph_id, id) FROM rem)")(lambda p: cascade.one_round(p.arcs, p.removals))

# Cycles: an edge is no bridge if its ends stay connected without it.
BRIDGE_SQL = """walk AS (SELECT graph_id, edge_id, src, dst, src AS seen FROM edges UNION SELECT w.graph_id, w.edge_id, w.src, w.dst, a.dst FROM walk w JOIN arcs a ON a.graph_id = w.graph_id AND a.src = w.seen AND a.edge_id <> w.edge_id),
loops AS (SELECT DISTINCT graph_id, edge_id, src, dst FROM walk WHERE seen = dst), cyc AS (SELECT graph_id, src id FROM loops UNION SELECT graph_id, dst FROM loops)"""
pooled("bridges", "SELECT graph_id, src, dst FROM edges WHERE (graph_id, edge_id) NOT IN (SELECT (graph_id, edge_id) FROM loops)", BRIDGE_SQL, loops=True)(lambda p: forest.bridges(p.edges).drop("edge_id"))
pooled("cycle_vertices", "SELECT graph_id, id FROM cyc", BRIDGE_SQL, loops=True)(lambda p: forest.cycle_vertices(p.edges))
pooled("cnr", "SELECT graph_id, n, CAST(count(id) AS BIGINT) cyclic, round(count(id) / CAST(n AS DOUBLE), 6) cnr FROM counts LEFT JOIN cyc USING (graph_id) GROUP BY 1, 2", BRIDGE_SQL, loops=True)(lambda p: rounded(cycles.cycle_ratio(forest.cycle_vertices(p.edges), p.counts).drop("m"), "cnr"))


def cnr_curve(p: Pool) -> DataFrame:
    return decycling.cycle_ratio_curve(p.solution, p.edges, p.counts)


#: The cycle ratio after each of the first vertices of the solution.
FIRSTS_SQL = "firsts AS (SELECT s.graph_id, k, n FROM counts s, range(0, 5) t(k))"
WALK_SQL = ("ke AS (SELECT e.graph_id, k, edge_id, src, dst FROM edges e JOIN firsts f ON f.graph_id = e.graph_id JOIN sol a ON a.graph_id = e.graph_id AND a.id = e.src JOIN sol b ON b.graph_id = e.graph_id AND b.id = e.dst WHERE least(a.pos, b.pos) >= k)",
"karcs AS (SELECT graph_id, k, edge_id, src, dst FROM ke UNION ALL SELECT graph_id, k, edge_id, dst, src FROM ke)",
"kwalk AS (SELECT graph_id, k, edge_id, src, dst, src AS seen FROM ke UNION SELECT w.graph_id, w.k, w.edge_id, w.src, w.dst, a.dst FROM kwalk w JOIN karcs a ON a.graph_id = w.graph_id AND a.k = w.k AND a.src = w.seen AND a.edge_id <> w.edge_id)",
"kcyc AS (SELECT graph_id, k, src id FROM kwalk WHERE seen = dst UNION SELECT graph_id, k, dst FROM kwalk WHERE seen = dst)")
START_SQL = (FIRSTS_SQL, *WALK_SQL)
pooled("cnr_curve")(lambda p: rounded(cnr_curve(p), "cnr"))
pooled("cnr_curve_start", "SELECT f.graph_id, f.k, CAST(count(c.id) AS BIGINT) cyclic, round(count(c.id) / CAST(f.n AS DOUBLE), 6) cnr FROM firsts f LEFT JOIN kcyc c USING (graph_id, k) GROUP BY f.graph_id, f.k, f.n", *START_SQL)(lambda p: rounded(cnr_curve(p).where("k < 5").drop("id"), "cnr"))
#: The cycle ratio at the checkpoints of the whole solution.
POINTS_SQL = ("firsts AS (SELECT graph_id, CAST(ceil(n / 10.0) AS BIGINT) * i AS k, n FROM counts, range(0, 11) t(i) WHERE CAST(ceil(n / 10.0) AS BIGINT) * i < n)", *WALK_SQL)
pooled("cnr_curve_checkpoints", "SELECT f.graph_id, f.k, CAST(count(c.id) AS BIGINT) cyclic, round(count(c.id) / CAST(f.n AS DOUBLE), 6) cnr FROM firsts f LEFT JOIN kcyc c USING (graph_id, k) GROUP BY f.graph_id, f.k, f.n", *POINTS_SQL, loops=True)(lambda p: rounded(forest.cycle_ratio_checkpoints(p.solution, p.edges, p.counts), "cnr"))
pooled("episode_steps")(lambda p: rounded(decycling.episode_steps(cnr_curve(p)), "reward"))
pooled("solution_prefix")(lambda p: rounded(decycling.prefix_above(cnr_curve(p), 0.05), "cnr"))
pooled("pool_insert", "SELECT graph_id, edge_id, src, dst, value FROM edges UNION ALL SELECT graph_id + 10, edge_id, src, dst, value FROM edges WHERE graph_id < 3")(lambda p: pools.insert_graphs(p.edges, p.edges.where("graph_id < 3").withColumn("graph_id", F.col("graph_id") + 10)))
def draw_sql(seed: int, *columns: str) -> str:
    """``functions.draw``."""
    h = str(seed)
    for c in columns:
        h = f"list_transform([({h} * 48271 + {c}) % 2147483647], lambda h: (h * h + 12 * h) % 2147483647 * 48271 % 2147483647)[1]"
    return h


pooled("pool_sample", f"SELECT draw, graph_id FROM (SELECT CAST(i AS BIGINT) AS draw, {draw_sql(1, 'i')} % (SELECT count(*) FROM counts) AS r FROM range(0, 16) t(i)) JOIN (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS r FROM counts) USING (r)")(lambda p: pools.sample_graphs(p.edges, 16, 1))
pooled("edge_add", "SELECT graph_id, edge_id, src, dst, value FROM edges UNION ALL SELECT graph_id, m, 0, 1000000, CAST(0.5 AS DOUBLE) FROM counts")(lambda p: pools.add_edges(p.edges, p.edges.select("graph_id", F.lit(1_000_000).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.5).alias("value")).union(p.edges.select("graph_id", "dst", "src", "value"))))
pooled("two_core", loops=True)(lambda p: cycles.two_core(p.edges))
pooled("decycle_greedy")(lambda p: policies.decycle_order(p.edges))
for _name, _centrality in (("hda", "degree"), ("hpra", "pagerank"), ("hca", "closeness"), ("hba", "betweenness")):
    pooled(_name, loops=True)(lambda p, c=_centrality: policies.adaptive_order(p.edges, c))
pooled("betweenness_core", loops=True)(lambda p: rounded(betweenness.by_sources(p.edges), "score"))
#: Nations that trade; all shortest paths are walked one by one.
TRADE_SQL = ("pairs AS (SELECT DISTINCT least(c_nationkey, s_nationkey) a, greatest(c_nationkey, s_nationkey) b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.1 AND c_nationkey <> s_nationkey)",
"arcs AS (SELECT CAST(a AS BIGINT) src, CAST(b AS BIGINT) dst FROM pairs UNION ALL SELECT b, a FROM pairs), v AS (SELECT DISTINCT src id FROM arcs), size AS (SELECT count(*) n FROM v)",
"hops AS (SELECT id s, id t, 0 d FROM v UNION SELECT s, dst, d + 1 FROM hops JOIN arcs ON src = t WHERE d < (SELECT n FROM size))",
"dist AS (SELECT s, t, min(d) d FROM hops GROUP BY 1, 2)",
"walks AS (SELECT id s, id t, 0 d FROM v UNION ALL SELECT w.s, dst, w.d + 1 FROM walks w JOIN arcs ON src = w.t JOIN dist q ON q.s = w.s AND q.t = dst AND q.d = w.d + 1)",
"paths AS (SELECT s, t, d, CAST(count(*) AS DOUBLE) p FROM walks GROUP BY 1, 2, 3)")
BETWEEN_SQL = """SELECT CAST(0 AS BIGINT) graph_id, v.id, round(coalesce(sum(x.p * y.p / st.p), 0) / ((SELECT n FROM size) - 1) / ((SELECT n FROM size) - 2), 6) score
FROM v LEFT JOIN paths x ON x.t = v.id AND x.s <> v.id LEFT JOIN paths y ON y.s = v.id AND y.t <> v.id AND y.t <> x.s LEFT JOIN paths st ON st.s = x.s AND st.t = y.t AND st.d = x.d + y.d GROUP BY v.id"""


@query("betweenness_small", BETWEEN_SQL, *TRADE_SQL)
def betweenness_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(betweenness.betweenness(trade_pool(spark, sf_dir).edges), "score")


pooled("random_policy", f"SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY {draw_sql(7, 'graph_id', 'id')}, id) - 1 AS BIGINT) AS pos, id FROM v")(lambda p: policies.random_order(p.vertices, 7))
pooled("reinsert_order")(lambda p: policies.reinsert_order(p.edges, p.removals.select("graph_id", F.col("step").alias("pos"), "id"), "rank", 0.01))




def evaluated(p: Pool) -> DataFrame:
    """Scores of the first tenth by degree as it is and re-inserted."""
    sol = p.removals.select("graph_id", F.col("step").alias("pos"), "id")
    score = lambda k: policies.evaluate_solution(p.edges, sol, p.vertices, p.counts, k, 0.01)[0].select("graph_id", F.lit(k).alias("strategy"), "robustness")
    return score(0).union(score(2)).union(score(3))


pooled("evaluate_solution", loops=True)(evaluated)

# Replay
N = STEPS
NSTEP_SQL = f"""SELECT episode, step, action, reward, round(sum(reward) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) suffix_sum, round(sum(reward) OVER (w ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING), 6) nstep_return,
lead(action, {N}) OVER w next_action, step + {N} >= count(*) OVER (PARTITION BY episode) terminal, step AS state_len FROM steps WINDOW w AS (PARTITION BY episode ORDER BY step)"""
query("nstep_returns", NSTEP_SQL, STEPS_SQL)(lambda s, d: rounded(replay.nstep(episodes(s, d), N), "suffix_sum", "nstep_return"))
query("nstep_next_action", f"SELECT episode, step, lead(action, {N}) OVER (PARTITION BY episode ORDER BY step) next_action FROM steps", STEPS_SQL)(lambda s, d: replay.nstep(episodes(s, d), N).select("episode", "step", "next_action"))
query("suffix_sum_rewards", "SELECT episode, step, round(sum(reward) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) suffix_sum FROM steps", STEPS_SQL)(lambda s, d: rounded(replay.nstep(episodes(s, d), N).select("episode", "step", "suffix_sum"), "suffix_sum"))
query("successor_state", f"SELECT s.episode, s.step, string_agg(CAST(t.action AS VARCHAR), ',' ORDER BY t.step) next_state FROM steps s JOIN steps t ON t.episode = s.episode AND t.step < s.step + {N} GROUP BY 1, 2", STEPS_SQL)(lambda s, d: replay.successor_state(episodes(s, d), N).withColumn("next_state", F.array_join(F.col("next_state").cast("array<string>"), ",")))
query("state_prefix", "SELECT episode, step, coalesce(string_agg(CAST(action AS VARCHAR), ',') OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') state FROM steps", STEPS_SQL)(lambda s, d: replay.state_prefix(episodes(s, d)).withColumn("state", F.array_join(F.col("state").cast("array<string>"), ",")))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of the last CAPACITY events: slot, seq, error."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), (F.abs(F.col("value")) % 1.0).alias("error"))
    first = e.agg(F.min("seq").alias("first"))
    return replay.ring(e.join(F.broadcast(first)).select((F.col("seq") - F.col("first")).alias("seq"), "error"), CAPACITY)


RING_SQL = f"""ev AS (SELECT event_id - (SELECT min(event_id) FROM events) AS seq, abs(value) % 1.0 AS error FROM events),
slots AS (SELECT seq, CAST(seq % {CAPACITY} AS BIGINT) slot, error, pow(least(error + 0.01, 1.0), 0.6) AS priority FROM ev WHERE seq > (SELECT max(seq) FROM ev) - {CAPACITY})"""
query("replay_ring_slots", "SELECT slot, seq FROM slots", RING_SQL)(lambda s, d: memory(s, d).select("slot", "seq"))
query("per_priorities", "SELECT slot, round(priority, 6) AS priority FROM slots", RING_SQL)(lambda s, d: rounded(memory(s, d).select("slot", replay.priority(F.col("error")).alias("priority")), "priority"))
query("priority_start", "SELECT round(max(priority), 6) AS priority FROM slots", RING_SQL)(lambda s, d: rounded(replay.start_priority(memory(s, d).select(replay.priority(F.col("error")).alias("priority"))), "priority"))
DEEP = 2 * (CAPACITY - 512)
LEAF_SQL = f"cum AS (SELECT slot, priority, sum(priority) OVER (ORDER BY CASE WHEN slot >= {CAPACITY - DEEP} THEN slot - {CAPACITY - DEEP} ELSE slot + {DEEP} END) hi FROM slots), draws AS (SELECT CAST(i AS BIGINT) draw, (i + 0.5) * (SELECT sum(priority) FROM slots) / 32 AS v FROM range(0, 32) t(i))"


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.stratified(memory(spark, sf_dir).select("slot", replay.priority(F.col("error")).alias("priority")), CAPACITY, 32)


query("per_stratified_sample", "SELECT draw, slot, round(priority, 6) AS priority FROM draws JOIN cum ON hi - priority < v AND v <= hi", RING_SQL, LEAF_SQL)(lambda s, d: rounded(sampled(s, d).select("draw", "slot", "priority"), "priority"))
query("per_is_weights", "SELECT draw, round(pow(priority / (SELECT min(priority) FROM slots), -0.4), 6) AS weight FROM draws JOIN cum ON hi - priority < v AND v <= hi", RING_SQL, LEAF_SQL)(lambda s, d: rounded(sampled(s, d).select("draw", "weight"), "weight"))
query("uniform_sample", f"SELECT draw, slot FROM (SELECT CAST(i AS BIGINT) AS draw, {draw_sql(1, 'i')} % (SELECT count(*) FROM slots) AS r FROM range(0, 32) t(i)) JOIN (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS r FROM slots) USING (r)", RING_SQL)(lambda s, d: replay.uniform(memory(s, d), 32, 1))

# Reports
ANC_SQL = """a AS (SELECT method, graph_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE avg(CASE WHEN c.pos > 0 AND f.cnr <> 0 THEN c.cnr / f.cnr END) END a FROM curves c JOIN (SELECT method, graph_id, cnr FROM curves WHERE pos = 0) f USING (method, graph_id) GROUP BY 1, 2)"""
query("anc", "SELECT method, round(avg(a), 6) AS anc FROM a GROUP BY 1", CURVES_SQL, ANC_SQL)(lambda s, d: rounded(metrics.anc(event_curves(s, d)).select("method", "anc"), "anc"))
query("anc_std", "SELECT method, round(stddev_samp(a), 6) AS std FROM a GROUP BY 1", CURVES_SQL, ANC_SQL)(lambda s, d: rounded(metrics.anc(event_curves(s, d)).select("method", "std"), "std"))
query("padded_mean_curve", "SELECT method, pos, round(sum(cnr) / max(n), 6) AS cnr FROM curves JOIN (SELECT method, CAST(count(DISTINCT graph_id) AS DOUBLE) n FROM curves GROUP BY 1) USING (method) GROUP BY 1, 2", CURVES_SQL)(lambda s, d: rounded(metrics.padded_mean(event_curves(s, d)), "cnr"))
query("truncated_curves", "SELECT method, graph_id, pos, cnr FROM curves JOIN (SELECT method, min(l) l FROM (SELECT method, graph_id, max(pos) l FROM curves GROUP BY 1, 2) GROUP BY 1) USING (method) WHERE pos <= l", CURVES_SQL)(lambda s, d: metrics.truncated(event_curves(s, d)))
query("first_below_threshold", "SELECT method, graph_id, min(CASE WHEN cnr < 20 THEN pos END) AS pos FROM curves GROUP BY 1, 2", CURVES_SQL)(lambda s, d: metrics.first_below(event_curves(s, d), 20.0))
query("first_at_threshold", "SELECT method, graph_id, min(CASE WHEN floor(cnr) <= 20 THEN pos END) AS pos FROM curves GROUP BY 1, 2", CURVES_SQL)(lambda s, d: metrics.first_below(event_curves(s, d).withColumn("cnr", F.floor("cnr").cast("double")), 20.0, inclusive=True))
query("mean_solution_size", "SELECT method, CAST(avg(l) AS DOUBLE) AS size FROM (SELECT method, graph_id, count(*) l FROM curves GROUP BY 1, 2) GROUP BY 1", CURVES_SQL)(lambda s, d: event_curves(s, d).groupBy("method", "graph_id").agg(F.count(F.lit(1)).alias("l")).groupBy("method").agg(F.avg("l").alias("size")))
query("mean_time", "SELECT method, round(avg(t), 6) AS time FROM (SELECT method, graph_id, sum(cnr) t FROM curves GROUP BY 1, 2) GROUP BY 1", CURVES_SQL)(lambda s, d: rounded(event_curves(s, d).groupBy("method", "graph_id").agg(F.sum("cnr").alias("t")).groupBy("method").agg(F.avg("t").alias("time")), "time"))
query("mean_time_two_sources", "SELECT method, round(avg(t), 6) AS time FROM (SELECT a.method, a.graph_id, a.t + b.t AS t FROM (SELECT event_type AS method, user_id graph_id, sum(abs(value)) t FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2) a JOIN (SELECT event_type AS method, user_id graph_id, sum(abs(value)) t FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) b USING (method, graph_id)) GROUP BY 1")(lambda s, d: rounded(metrics.mean_of_sums(*(s.read.parquet(f"{d}/events.parquet").where(F.col("event_id") % 2 == part).groupBy(F.col("event_type").alias("method"), F.col("user_id").alias("graph_id")).agg(F.sum(F.abs("value")).alias("time")) for part in (0, 1))), "time"))


def bucket_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_curves(spark, sf_dir).groupBy("method", (F.col("graph_id") % 4).alias("bucket")).agg(F.sum("cnr").alias("time"))


TIMES_SQL = "times AS (SELECT method, graph_id % 4 AS bucket, sum(cnr) AS time FROM curves GROUP BY 1, 2)"
query("ratio_to_baseline", "SELECT t.method, t.bucket, round(t.time / b.time, 6) AS ratio FROM times t JOIN times b ON b.bucket = t.bucket AND b.method = 'view'", CURVES_SQL, TIMES_SQL)(lambda s, d: rounded(metrics.ratio_to_baseline(bucket_times(s, d), "view"), "ratio"))
pooled("cost_curve_inclusive", "SELECT graph_id, pos, round(sum(degree) OVER (PARTITION BY graph_id ORDER BY pos) / CAST(sum(degree) OVER (PARTITION BY graph_id) AS DOUBLE), 6) AS cost FROM sol")(lambda p: rounded(metrics.cost_axis(p.solution, F.col("degree")), "cost"))
pooled("cost_curve_exclusive", "SELECT graph_id, pos, round(coalesce(sum(degree) OVER (PARTITION BY graph_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(sum(degree) OVER (PARTITION BY graph_id) AS DOUBLE), 6) AS cost FROM sol")(lambda p: rounded(metrics.cost_axis(p.solution, F.col("degree"), False), "cost"))
pooled("removed_fraction", "SELECT graph_id, pos, round(pos / CAST(n AS DOUBLE), 6) AS fraction FROM sol JOIN counts USING (graph_id)")(lambda p: rounded(p.solution.join(F.broadcast(p.counts), "graph_id").select("graph_id", "pos", (F.col("pos") / F.col("n")).alias("fraction")), "fraction"))
pooled("removed_degree_hist", "SELECT graph_id, degree, CAST(count(*) AS BIGINT) vertices FROM deg JOIN rem USING (graph_id, id) GROUP BY 1, 2")(lambda p: metrics.degree_histogram(p.degrees.join(p.removals, ["graph_id", "id"])))


@query("heatmap_pivot_avg", "SELECT dataset, " + ", ".join(f"round(avg(CASE WHEN method = '{m}' THEN value END), 6) AS {m}" for m in METHODS) + " FROM heat GROUP BY 1 UNION ALL SELECT 'average', " + ", ".join(f"round(avg({m}), 6)" for m in METHODS) + " FROM (SELECT dataset, " + ", ".join(f"avg(CASE WHEN method = '{m}' THEN value END) AS {m}" for m in METHODS) + " FROM heat GROUP BY 1)", CURVES_SQL, "heat AS (SELECT 'd' || CAST(graph_id % 8 AS VARCHAR) AS dataset, method, cnr AS value FROM curves)")
def heatmap_pivot_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = event_curves(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("graph_id") % 8).cast("string")).alias("dataset"), "method", F.col("cnr").alias("value"))
    return rounded(metrics.heatmap(scores, METHODS), *METHODS)


def streamed(spark: SparkSession, sf_dir: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``run`` makes of the events as a stream, all of them at once."""
    import uuid

    from .plans.derive import shared_path

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"
    run(events).writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


RING_ROW_SQL = """SELECT memory, seq, CAST((row_number() OVER w - 1) % 8 AS BIGINT) slot, round(priority, 6) priority, lag(seq, 8) OVER w gone, round(min(priority) OVER w, 6) least, round(max(priority) OVER w, 6) most
FROM (SELECT user_id memory, event_id seq, pow(least(abs(value) % 1.0 + 0.01, 1.0), 0.6) priority FROM events) WINDOW w AS (PARTITION BY memory ORDER BY seq)"""


@query("stream_ring", RING_ROW_SQL)
def stream_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of 8 slots a user."""
    from .streaming import stateful

    stateful.rocksdb(spark)
    rows = lambda e: e.select(F.col("user_id").alias("memory"), F.col("event_id").alias("seq"), replay.priority(F.abs(F.col("value")) % 1.0).alias("priority"))
    return rounded(streamed(spark, sf_dir, lambda e: stateful.stream_ring(rows(e), 8)), "priority", "least", "most")


@query("priority_history", f"SELECT round(min(priority), 6) AS least, round(max(priority), 6) AS most, round(coalesce(max(priority), 1.0), 6) AS start FROM (SELECT pow(least(error + 0.01, 1.0), 0.6) AS priority FROM ev)", RING_SQL)
def priority_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities over all history, overwritten rows included."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(replay.history(e.select(replay.priority(F.abs(F.col("value")) % 1.0).alias("priority"))), "least", "most", "start")


@query("stream_nstep", f"SELECT episode, action AS seq, action, reward, round(nr, 6) AS nstep_return, next_action, next_action IS NULL AS terminal FROM (SELECT *, sum(reward) OVER (w ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING) nr, lead(action, {N}) OVER w next_action FROM (SELECT user_id episode, event_id AS action, value reward FROM events) WINDOW w AS (PARTITION BY episode ORDER BY action))")
def stream_nstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, all of them at once, into a table of transitions."""
    import uuid

    from .plans.derive import shared_path
    from .streaming.replay import stream_nstep as run

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    steps = events.select(F.col("user_id").alias("episode"), F.col("event_id").alias("seq"), F.col("event_id").alias("action"), F.col("value").alias("reward"))
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("episode")).agg(F.max("event_id").alias("end"))
    steps = steps.join(ends, "episode").select("episode", "seq", "action", "reward", (F.col("seq") == F.col("end")).alias("last"))
    out = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"
    run(steps, N).writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(out), "nstep_return")
