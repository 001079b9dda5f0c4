"""A pool of graphs derived from the order tables, and lineage cuts for loops."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import edge_probability


def shared_path(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one (tests) gets
    a temporary folder; on a cluster that folder would not be shared, so it raises."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="unravel-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back. The result outlives any
    executor and has the table's own size as its statistics: in a loop, a checkpoint
    would keep its plan's estimate, whose digits double with every self-join."""
    path = f"{shared_path(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table of ``cut``; nothing may read it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge as two arcs (graph_id, src, dst, edge_id, value), without a shuffle."""
    arcs = F.explode(F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select("graph_id", "edge_id", "value", arcs.alias("a")).select("graph_id", "a.src", "a.dst", "edge_id", "value")


@dataclass
class Pool:
    """edges (graph_id, edge_id, src < dst, value); all else follows from them."""

    edges: DataFrame

    @cached_property
    def arcs(self) -> DataFrame:
        return both_ways(self.edges)

    @cached_property
    def vertices(self) -> DataFrame:
        return self.arcs.select("graph_id", F.col("src").alias("id")).distinct()

    @cached_property
    def degrees(self) -> DataFrame:
        return self.arcs.groupBy("graph_id", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))

    @cached_property
    def solution(self) -> DataFrame:
        """Static removal order: degree falling, then id; pos from 0."""
        w = Window.partitionBy("graph_id").orderBy(F.desc("degree"), "id")
        return self.degrees.withColumn("pos", F.row_number().over(w).cast("long") - 1)

    @cached_property
    def counts(self) -> DataFrame:
        return self.degrees.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("m"))

    @cached_property
    def removals(self) -> DataFrame:
        """The first tenth of the solution: graph_id, id, step."""
        sized = self.solution.join(F.broadcast(self.counts), "graph_id")  # one row a graph
        return sized.where("pos * 10 < n").select("graph_id", "id", F.col("pos").alias("step"))


def order_pool(spark: SparkSession, sf_dir: str, least_quantity: int = 40) -> Pool:
    """Parts that occur in one order, both lines of at least ``least_quantity``; one
    graph an order priority."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_quantity") >= least_quantity)
    lines = lines.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.substring("o_orderpriority", 1, 1).cast("long").alias("graph_id"))
    a, b = lines.select("k", F.col("p").alias("src")), lines.select("k", F.col("p").alias("dst"))
    pairs = a.join(b, "k").where("src < dst").join(orders, "k").select("graph_id", "src", "dst").distinct()
    w = Window.partitionBy("graph_id").orderBy("src", "dst")
    return Pool(pairs.select("graph_id", (F.row_number().over(w) - 1).cast("long").alias("edge_id"), "src", "dst", edge_probability(F.col("src"), F.col("dst")).alias("value")))


def trade_pool(spark: SparkSession, sf_dir: str, least_quantity: int = 50, least_discount: float = 0.1) -> Pool:
    """Nations that trade: one graph, an edge between the nations of a customer and a
    supplier with a line of at least these terms."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").where((F.col("l_quantity") >= least_quantity) & (F.col("l_discount") >= least_discount)).select("l_orderkey", "l_suppkey")
    buyers = read("orders").select("o_orderkey", "o_custkey").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a")), "o_custkey")
    sellers = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    pairs = lines.join(buyers, lines.l_orderkey == buyers.o_orderkey).join(sellers, "l_suppkey").where("a <> b")
    pairs = pairs.select(F.least("a", "b").cast("long").alias("src"), F.greatest("a", "b").cast("long").alias("dst")).distinct()
    w = Window.orderBy("src", "dst")  # a pair of nations is a row at most
    return Pool(pairs.select(F.lit(0).cast("long").alias("graph_id"), (F.row_number().over(w) - 1).cast("long").alias("edge_id"), "src", "dst", edge_probability(F.col("src"), F.col("dst")).alias("value")))
