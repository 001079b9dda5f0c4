"""Residual graphs after removals, and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import hub_join
from ..plans.derive import both_ways


def _gone(removals: DataFrame, name: str) -> DataFrame:
    return removals.select("graph_id", F.col("id").alias(name)).distinct()


def residual_edges(edges: DataFrame, removals: DataFrame) -> DataFrame:
    """Edges neither of whose ends is removed."""
    return edges.join(_gone(removals, "src"), ["graph_id", "src"], "left_anti").join(_gone(removals, "dst"), ["graph_id", "dst"], "left_anti").select(*edges.columns)


def residual_vertices(vertices: DataFrame, removals: DataFrame) -> DataFrame:
    """Vertices that aren't removed, isolated ones included."""
    return vertices.join(_gone(removals, "id"), ["graph_id", "id"], "left_anti").select(*vertices.columns)


def touched_edges(arcs: DataFrame, removals: DataFrame) -> DataFrame:
    """graph_id, edges: the ids of the edges that removals touch, each once, rising."""
    hit = arcs.join(_gone(removals, "src"), ["graph_id", "src"]).select("graph_id", "edge_id").distinct()
    return hit.groupBy("graph_id").agg(F.array_sort(F.collect_list("edge_id")).alias("edges"))


def removal_flags(vertices: DataFrame, removals: DataFrame) -> DataFrame:
    """graph_id, id, idx: -1 removed, 0 residual."""
    gone = _gone(removals, "id").withColumn("gone", F.lit(True))
    return vertices.join(gone, ["graph_id", "id"], "left").select("graph_id", "id", F.when(F.col("gone"), -1).otherwise(0).cast("long").alias("idx"))


def wedge_counts(edges: DataFrame) -> DataFrame:
    """graph_id, wedges: paths of two edges, the sum of d (d - 1) / 2."""
    d = both_ways(edges).groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("d"))
    return d.groupBy("graph_id").agg((F.sum(F.col("d") * (F.col("d") - 1)) / 2).cast("long").alias("wedges"))


def status(vertices: DataFrame, edges: DataFrame, removals: DataFrame) -> DataFrame:
    """Per graph: n, removed, available, edges, removed_edges, wedges and three_hop of
    the residual graph, covered_frac (null for no vertex), bias, edge_frac,
    wedge_density."""
    n = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    r = removals.groupBy("graph_id").agg(F.countDistinct("id").alias("removed"), F.count(F.lit(1)).alias("raw"))
    left = residual_edges(edges, removals)
    m, k = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")), left.groupBy("graph_id").agg(F.count(F.lit(1)).alias("kept"))
    out = n.join(r, "graph_id", "left").join(m, "graph_id", "left").join(k, "graph_id", "left").join(wedge_counts(left), "graph_id", "left").na.fill(0)
    out = out.withColumn("removed_edges", F.col("edges") - F.col("kept")).withColumn("available", F.col("n") - F.col("removed"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("graph_id", "n", "removed", "available", "edges", "removed_edges", "wedges", F.lit(0).cast("long").alias("three_hop"), share("raw", "n").alias("covered_frac"), F.lit(1.0).alias("bias"), share("removed_edges", "edges").alias("edge_frac"), F.when(F.col("n") > 0, F.col("wedges") / (F.col("n") * F.col("n"))).alias("wedge_density"))


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Arcs with ids 2k and 2k + 1 over the edges in order of edge_id."""
    w = Window.partitionBy("graph_id").orderBy("edge_id")
    k = edges.withColumn("k", F.row_number().over(w).cast("long") - 1)
    arcs = F.explode(F.array(F.struct((F.col("k") * 2).alias("arc_id"), "src", "dst"), F.struct((F.col("k") * 2 + 1).alias("arc_id"), F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return k.select("graph_id", arcs.alias("a")).select("graph_id", "a.*")


def adjacency(arcs: DataFrame) -> DataFrame:
    """graph_id, id, neighbours (array, rising)."""
    return arcs.groupBy("graph_id", F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def common_neighbor_pairs(arcs: DataFrame, vertices: DataFrame, removals: DataFrame) -> DataFrame:
    """graph_id, pairs: pairs of residual vertices with a neighbour in common, which
    may itself be removed. Wedges by an equi-join, never all pairs."""
    live = residual_vertices(vertices, removals)
    a = arcs.join(live.withColumnRenamed("id", "dst"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("mid"), F.col("dst").alias("x"))
    pairs = hub_join(a, a.withColumnRenamed("x", "y"), ["graph_id", "mid"]).where("x < y").select("graph_id", "x", "y").distinct()
    return pairs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("pairs"))


def symmetric_difference(vertices: DataFrame, solution: DataFrame) -> DataFrame:
    """Vertices in one of the two and not the other."""
    a, b = vertices.select("graph_id", "id"), solution.select("graph_id", "id")
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()
