"""A pool of graphs as rows (graph_id, edge_id, src, dst, value) that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import draw


def insert_graphs(pool: DataFrame, graphs: DataFrame) -> DataFrame:
    """``pool`` with the edges of ``graphs``; raises if a graph_id is in both."""
    both = graphs.select("graph_id").distinct().join(pool.select("graph_id").distinct(), "graph_id", "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"graph {both[0].graph_id} is in the pool")
    return pool.unionByName(graphs)


def get_graph(pool: DataFrame, graph_id: int) -> DataFrame:
    return pool.where(F.col("graph_id") == graph_id)


def sample_graphs(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` graph ids drawn with replacement: draw, graph_id. The draws are
    ``functions.draw`` of the seed, so they come out the same wherever they run."""
    ids = pool.select("graph_id").distinct().withColumn("r", F.row_number().over(Window.orderBy("graph_id")) - 1)  # one row a graph
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw")).join(F.broadcast(ids.agg(F.count(F.lit(1)).alias("size"))))
    return draws.where("size > 0").select("draw", F.pmod(draw(seed, F.col("draw")), F.col("size")).alias("r")).join(ids, "r").select("draw", "graph_id")


def clear(pool: DataFrame) -> DataFrame:
    return pool.limit(0)


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` (graph_id, src, dst, value) that a graph lacks,
    smaller end first, numbered on; ends that are new become vertices with them."""
    plain = new.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "value").where("src <> dst").dropDuplicates(["graph_id", "src", "dst"])
    lacking = plain.join(edges, ["graph_id", "src", "dst"], "left_anti")
    count = edges.groupBy("graph_id").agg((F.max("edge_id") + 1).alias("first"))
    order = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst")) - 1
    numbered = lacking.join(count, "graph_id", "left").select("graph_id", (F.coalesce("first", F.lit(0)) + order).cast("long").alias("edge_id"), "src", "dst", "value")
    return edges.select("graph_id", "edge_id", "src", "dst", "value").union(numbered)
