"""Batches: the disjoint union of residual graphs with dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def relabel(request: DataFrame, vertices: DataFrame, removals: DataFrame) -> DataFrame:
    """batch_pos, graph_id, id, global_id: residual vertices numbered from 0 in order
    of (batch_pos, id). ``request``: (batch_pos, graph_id), graphs may repeat; removals
    are keyed by batch_pos. Ranks are per graph; only one row a graph is summed up."""
    v = request.join(vertices, "graph_id").join(removals.select("batch_pos", "id").distinct(), ["batch_pos", "id"], "left_anti")
    v = v.withColumn("rank", F.row_number().over(Window.partitionBy("batch_pos").orderBy("id")).cast("long") - 1)
    return v.join(F.broadcast(offsets(request, v)), "batch_pos").select("batch_pos", "graph_id", "id", (F.col("offset") + F.col("rank")).alias("global_id"))


def offsets(request: DataFrame, residual: DataFrame) -> DataFrame:
    """batch_pos, size, offset of every graph of the batch, empty ones included."""
    sizes = request.select("batch_pos").join(residual.groupBy("batch_pos").agg(F.count(F.lit(1)).alias("size")), "batch_pos", "left").na.fill(0)
    before = F.coalesce(F.sum("size").over(Window.orderBy("batch_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("batch_pos", "size", before.cast("long").alias("offset"))


def spans(request: DataFrame, labels: DataFrame) -> DataFrame:
    """batch_pos, first, last: the inclusive range of global ids; (total, total) for
    an empty graph."""
    o = offsets(request, labels)
    total = o.agg(F.sum("size").alias("total"))
    filled = F.col("size") > 0
    return o.join(F.broadcast(total)).select("batch_pos", F.when(filled, F.col("offset")).otherwise(F.col("total")).cast("long").alias("first"), F.when(filled, F.col("offset") + F.col("size") - 1).otherwise(F.col("total")).cast("long").alias("last"))


def batch_edges(request: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """batch_pos, edge_id, src, dst of the residual edges by global id."""
    s = labels.select("batch_pos", F.col("id").alias("src"), F.col("global_id").alias("gs"))
    d = labels.select("batch_pos", F.col("id").alias("dst"), F.col("global_id").alias("gd"))
    return request.join(edges, "graph_id").join(s, ["batch_pos", "src"]).join(d, ["batch_pos", "dst"]).select("batch_pos", "edge_id", F.col("gs").alias("src"), F.col("gd").alias("dst"))


def select_actions(actions: DataFrame, labels: DataFrame) -> DataFrame:
    """row (batch_pos), col (global id), value 1 of each action; an action on a
    removed vertex raises."""
    chosen = actions.join(labels, ["batch_pos", "id"], "left")
    col = F.when(F.col("global_id").isNull(), F.raise_error(F.lit("action is not a residual vertex")).cast("long")).otherwise(F.col("global_id"))
    return chosen.select(F.col("batch_pos").alias("row"), col.alias("col"), F.lit(1.0).alias("value"))


def membership(labels: DataFrame) -> DataFrame:
    """graphs x vertices, 1 where the vertex is the graph's."""
    return labels.select(F.col("batch_pos").alias("row"), F.col("global_id").alias("col"), F.lit(1.0).alias("value"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def masked_membership(masks: DataFrame) -> DataFrame:
    """(row, local index, 1) where ``mask`` (array of 0/1, by batch_pos) is 1."""
    e = masks.select(F.col("batch_pos").alias("row"), F.posexplode("mask").alias("col", "on"))
    return e.where("on = 1").select("row", F.col("col").cast("long").alias("col"), F.lit(1.0).alias("value"))


def setup(request: DataFrame, vertices: DataFrame, edges: DataFrame, removals: DataFrame, actions: DataFrame | None = None, aggregator: str = "sum") -> dict[str, DataFrame]:
    """All tables of a batch: labels, spans, edges, n2n (``matrix.node_to_node``),
    laplacian, membership, rep_global and, with ``actions`` (batch_pos, id: training),
    act_select. Matrices are of global ids. ``request``: (batch_pos, graph_id);
    ``removals``: (batch_pos, id)."""
    from . import matrix

    labels = relabel(request, vertices, removals)
    left = batch_edges(request, edges, labels)
    arcs = left.select(F.lit(0).cast("long").alias("graph_id"), F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("a")).select("graph_id", "a.*")
    out = {"labels": labels, "spans": spans(request, labels), "edges": left, "n2n": matrix.node_to_node(arcs, aggregator).drop("graph_id"), "laplacian": matrix.laplacian(arcs).drop("graph_id"), "membership": membership(labels)}
    out["rep_global"] = transpose(out["membership"])
    if actions is not None:
        out["act_select"] = select_actions(actions, labels)
    return out
