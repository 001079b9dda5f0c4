"""Reports that compare methods by their curves, sizes and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def anc(curves: DataFrame) -> DataFrame:
    """method, anc, std: the mean over graphs of the mean of cnr[k] / cnr[0], k >= 1;
    0 for curves of one point; null where cnr[0] is 0. ``curves``: method, graph_id,
    pos from 0, cnr."""
    first = F.max(F.when(F.col("pos") == 0, F.col("cnr"))).over(Window.partitionBy("method", "graph_id"))
    c = curves.withColumn("first", first)
    one = c.groupBy("method", "graph_id").agg(F.avg(F.when((F.col("pos") > 0) & (F.col("first") != 0), F.col("cnr") / F.col("first"))).alias("a"), F.count(F.lit(1)).alias("len"))
    one = one.withColumn("a", F.when(F.col("len") < 2, F.lit(0.0)).otherwise(F.col("a")))
    return one.groupBy("method").agg(F.avg("a").alias("anc"), F.stddev_samp("a").alias("std"))


def padded_mean(curves: DataFrame) -> DataFrame:
    """method, pos, cnr: position-wise means, short curves padded with 0. Sums over
    the number of curves: no grid is built."""
    n = curves.groupBy("method").agg(F.countDistinct("graph_id").alias("n"))
    s = curves.groupBy("method", "pos").agg(F.sum("cnr").alias("s"))
    return s.join(F.broadcast(n), "method").select("method", "pos", (F.col("s") / F.col("n")).alias("cnr"))


def truncated(curves: DataFrame) -> DataFrame:
    """All curves of a method cut to its shortest."""
    lens = curves.groupBy("method", "graph_id").agg(F.max("pos").alias("last")).groupBy("method").agg(F.min("last").alias("last"))
    return curves.join(F.broadcast(lens), "method").where("pos <= last").drop("last")


def first_below(curves: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """method, graph_id, pos: the first position under (or at) the threshold."""
    low = F.col("cnr") <= threshold if inclusive else F.col("cnr") < threshold
    return curves.groupBy("method", "graph_id").agg(F.min(F.when(low, F.col("pos"))).alias("pos"))


def cost_axis(solution: DataFrame, weight: Column, inclusive: bool = True) -> DataFrame:
    """graph_id, pos, cost: the running share of weight, with or without the row."""
    w = Window.partitionBy("graph_id").orderBy("pos")
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    total = F.sum(weight).over(Window.partitionBy("graph_id"))
    return solution.select("graph_id", "pos", (F.coalesce(F.sum(weight).over(frame), F.lit(0)) / total).alias("cost"))


def ratio_to_baseline(times: DataFrame, baseline: str) -> DataFrame:
    """method, bucket, ratio of ``times`` (method, bucket, time) to the baseline's."""
    base = times.where(F.col("method") == baseline).select("bucket", F.col("time").alias("base"))
    return times.join(F.broadcast(base), "bucket").select("method", "bucket", F.when(F.col("base") != 0, F.col("time") / F.col("base")).alias("ratio"))


def heatmap(scores: DataFrame, methods: list[str]) -> DataFrame:
    """dataset x method means, with a row of column means named 'average'."""
    wide = scores.groupBy("dataset").pivot("method", methods).agg(F.avg("value"))
    return wide.union(wide.agg(*(F.avg(F.col(f"`{m}`")).alias(m) for m in methods)).select(F.lit("average").alias("dataset"), *(F.col(f"`{m}`") for m in methods)))


def degree_shares(degrees: DataFrame) -> DataFrame:
    """graph_id, id, share (percent of all ends), cost (degree over the greatest)."""
    w = Window.partitionBy("graph_id")
    return degrees.select("graph_id", "id", (100.0 * F.col("degree") / F.sum("degree").over(w)).alias("share"), (F.col("degree") / F.max("degree").over(w)).alias("cost"))


def degree_histogram(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("graph_id", "degree").agg(F.count(F.lit(1)).alias("vertices"))


def degree_bins(degrees: DataFrame, bins: int = 10) -> DataFrame:
    """graph_id, bin (from 0), low, vertices, density: ``bins`` equal parts of the range of
    degrees, the last with its upper end; the densities' sum times the width is 1. A
    range of one degree is widened by a half on both sides. Empty bins are rows too."""
    ends = degrees.groupBy("graph_id").agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.count(F.lit(1)).alias("n"))
    flat = F.col("most") == F.col("least")
    ends = ends.select("graph_id", "n", F.when(flat, F.col("least") - 0.5).otherwise(F.col("least").cast("double")).alias("from"), F.when(flat, F.lit(1.0)).otherwise((F.col("most") - F.col("least")).cast("double")).alias("span"))
    at = degrees.join(F.broadcast(ends), "graph_id").select("graph_id", F.least(F.floor((F.col("degree") - F.col("from")) * bins / F.col("span")), F.lit(bins - 1)).cast("long").alias("bin"))  # one row a graph
    counts = at.groupBy("graph_id", "bin").agg(F.count(F.lit(1)).alias("vertices"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = every.join(counts, ["graph_id", "bin"], "left").na.fill(0, ["vertices"])
    return out.select("graph_id", "bin", (F.col("from") + F.col("bin") * F.col("span") / bins).alias("low"), "vertices", (F.col("vertices") * bins / F.col("span") / F.col("n")).alias("density"))


def shortest_share(solutions: DataFrame, share: float = 0.6) -> DataFrame:
    """method, graph_id, pos, id of ``solutions`` before k, ``share`` of the graph's
    shortest solution, cut to an integer: so all methods have as many removals."""
    lengths = solutions.groupBy("graph_id", "method").agg(F.count(F.lit(1)).alias("len")).groupBy("graph_id").agg(F.floor(F.min("len") * share).alias("k"))
    return solutions.join(F.broadcast(lengths), "graph_id").where("pos < k").select("method", "graph_id", "pos", "id")  # one row a graph


def mean_of_sums(first: DataFrame, second: DataFrame) -> DataFrame:
    """method, time: the mean over graphs of two sources' times (method, graph_id, time),
    added graph by graph; graphs of one source alone don't count."""
    both = first.join(second.withColumnRenamed("time", "__more"), ["method", "graph_id"])
    return both.groupBy("method").agg(F.avg(F.col("time") + F.col("__more")).alias("time"))
