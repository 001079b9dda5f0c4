"""Sparse matrices of graphs as (graph_id, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import hub_join


def _degree(arcs: DataFrame, name: str) -> DataFrame:
    return arcs.groupBy("graph_id", F.col("src").alias(name)).agg(F.count(F.lit(1)).alias(f"d_{name}"))


def node_to_node(arcs: DataFrame, aggregator: str = "sum") -> DataFrame:
    """``sum``: 1; ``mean``: 1 / d(row); ``gcn``: 1 / sqrt((d(row) + 1) (d(col) + 1)),
    without self loops. Any other aggregator raises."""
    a = arcs.select("graph_id", F.col("src").alias("row"), F.col("dst").alias("col"))
    if aggregator == "sum":
        return a.withColumn("value", F.lit(1.0))
    a = a.join(_degree(arcs, "row"), ["graph_id", "row"])
    if aggregator == "mean":
        return a.select("graph_id", "row", "col", (1.0 / F.col("d_row")).alias("value"))
    if aggregator != "gcn":
        raise ValueError(f"unknown aggregator: {aggregator}")
    a = a.join(_degree(arcs, "col"), ["graph_id", "col"])
    return a.select("graph_id", "row", "col", (1.0 / (F.sqrt(F.col("d_col") + 1.0) * F.sqrt(F.col("d_row") + 1.0))).alias("value"))


def weighted(arcs: DataFrame) -> DataFrame:
    """node_to_node by edge values."""
    return arcs.groupBy("graph_id", F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.sum("value").alias("value"))


def laplacian(arcs: DataFrame) -> DataFrame:
    """Degrees on the diagonal of vertices with edges, -1 beside it."""
    diagonal = _degree(arcs, "row").select("graph_id", "row", F.col("row").alias("col"), F.col("d_row").cast("double").alias("value"))
    return diagonal.union(arcs.select("graph_id", "src", "dst", F.lit(-1.0)))


def weighted_laplacian(arcs: DataFrame) -> DataFrame:
    """Sums of edge values on the diagonal, the values with a minus beside it."""
    w = weighted(arcs)
    diagonal = w.groupBy("graph_id", "row").agg(F.sum("value").alias("value")).select("graph_id", "row", F.col("row").alias("col"), "value")
    return diagonal.union(w.select("graph_id", "row", "col", (-F.col("value")).alias("value")))


def weighted_edge_to_node(arcs: DataFrame) -> DataFrame:
    """vertices x arcs, the arc's value at its target; ``arcs`` has arc_id and value."""
    return arcs.select("graph_id", F.col("dst").alias("row"), F.col("arc_id").alias("col"), "value")


def weighted_node_to_edge(arcs: DataFrame) -> DataFrame:
    """arcs x vertices, the arc's value at its source."""
    return arcs.select("graph_id", F.col("arc_id").alias("row"), F.col("src").alias("col"), "value")


def edge_to_node(arcs: DataFrame) -> DataFrame:
    """vertices x arcs, 1 at an arc's target."""
    return arcs.select("graph_id", F.col("dst").alias("row"), F.col("arc_id").alias("col"), F.lit(1.0).alias("value"))


def node_to_edge(arcs: DataFrame) -> DataFrame:
    """arcs x vertices, 1 at an arc's source."""
    return arcs.select("graph_id", F.col("arc_id").alias("row"), F.col("src").alias("col"), F.lit(1.0).alias("value"))


def edge_to_edge(arcs: DataFrame) -> DataFrame:
    """arcs x arcs: u->v follows w->u, w other than v (non-backtracking)."""
    a = arcs.select("graph_id", F.col("arc_id").alias("row"), F.col("src").alias("mid"), F.col("dst").alias("v"))
    b = arcs.select("graph_id", F.col("arc_id").alias("col"), F.col("dst").alias("mid"), F.col("src").alias("w"))
    return hub_join(a, b, ["graph_id", "mid"]).where("v <> w").select("graph_id", "row", "col", F.lit(1.0).alias("value"))
