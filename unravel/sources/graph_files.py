"""Readers and writers of graphs, removal orders, curves and timings as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))


def _field(block: str, name: str):
    return F.regexp_extract(block, rf'\b{name}\s+"?([^"\s\]]+)', 1)


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): (graph_id, id, label, weight) and (graph_id, edge_id, src,
    dst, value). graph_id is the last number in a file's name; edge ids are in file
    order; ends are swapped where src > dst."""
    files = _whole(spark, path).withColumn("graph_id", F.regexp_extract("file", r"(\d+)\D*$", 1).cast("long"))
    nodes = files.select("graph_id", F.explode(F.regexp_extract_all("value", F.lit(r"node\s*\[([^\]]*)\]"), F.lit(1))).alias("b"))
    number = lambda c, kind: F.when(c != "", c).cast(kind)
    v = nodes.select("graph_id", number(_field("b", "id"), "long").alias("id"), _field("b", "label").alias("label"), number(_field("b", "weight"), "double").alias("weight"))
    links = files.select("graph_id", F.posexplode(F.regexp_extract_all("value", F.lit(r"edge\s*\[([^\]]*)\]"), F.lit(1))).alias("p", "b"))
    e = links.select("graph_id", F.col("p").cast("long").alias("edge_id"), number(_field("b", "source"), "long").alias("s"), number(_field("b", "target"), "long").alias("t"), number(_field("b", "weight"), "double").alias("value"))
    return v, e.select("graph_id", "edge_id", F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst"), "value")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """src, dst of the first two fields of each line; the rest of it, comments and
    blank lines are left out."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2).select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, node, cnr: the first line is the ratio before any removal, others
    are "node, ratio"."""
    lines = _whole(spark, path).select("file", F.posexplode(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n")).alias("pos", "line"))
    two = F.split("line", ",", 2)
    return lines.select("file", F.col("pos").cast("long").alias("pos"), F.when(F.size(two) > 1, F.trim(two[0])).alias("node"), F.trim(F.element_at(two, -1)).cast("double").alias("cnr"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, value of files with a number a line."""
    return _whole(spark, path).select("file", F.posexplode(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n")).alias("pos", "v")).select("file", F.col("pos").cast("long").alias("pos"), F.trim("v").cast("double").alias("value"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """file, dataset, time of CSV files whose header names the datasets."""
    table = spark.read.csv(path, header=True)
    names = table.columns
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dataset"), F.col(f"`{c}`").cast("double").alias("time")) for c in names)))
    return table.select(F.input_file_name().alias("file"), pairs.alias("p")).select("file", "p.*")


def read_first_times(spark: SparkSession, path: str) -> DataFrame:
    """file, time: the first column of the first data row of timing files with a header."""
    lines = read_lines(spark, path).where("pos = 1")
    return lines.select("file", F.trim(F.split("line", ",", 2)[0]).cast("double").alias("time"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of small text files."""
    return _whole(spark, path).select("file", F.posexplode(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n")).alias("pos", "line"))


def graph_from_arrays(spark: SparkSession, graph_id: int, src: list[int], dst: list[int], value: list[float] | None = None) -> DataFrame:
    """Edges of one graph from parallel arrays; ids in order."""
    rows = [(graph_id, i, min(a, b), max(a, b), (value or [])[i] if value else None) for i, (a, b) in enumerate(zip(src, dst, strict=True))]
    return spark.createDataFrame(rows, "graph_id long, edge_id long, src long, dst long, value double")


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.lit("{}")).alias("value")).write.mode("overwrite").text(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """One file, a ratio a line with eight places, in order of k; a curve of one graph
    is bounded by its vertices."""
    curve.orderBy("k").coalesce(1).select(F.format_string("%.8f", "conn").alias("value")).write.mode("overwrite").text(path)


def write_timings(times: DataFrame, path: str) -> None:
    """One row, a column a dataset."""
    times.groupBy().pivot("dataset").agg(F.first("time")).coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_line(scores: DataFrame) -> DataFrame:
    """value: mean and deviation of ``score``, times 100."""
    return scores.agg(F.format_string("%.2f±%.2f", F.avg("score") * 100, F.stddev_pop("score") * 100).alias("value"))


def report(scores: DataFrame, ratios: DataFrame, differences: DataFrame, solutions: DataFrame, curves: DataFrame) -> DataFrame:
    """place, value: the lines of a report. Means and deviations, times 100, of the
    scores, cycle ratios and differences (each: score); then a line for each graph's
    solution (graph_id, pos, id) and, after a blank one, for its curve (graph_id, k, cnr).
    A line holds one graph's list."""
    names = ("scores", "ratios", "differences")
    every = [df.select(F.lit(name).alias("of"), "score") for name, df in zip(names, (scores, ratios, differences), strict=True)]
    of = lambda name: F.when(F.col("of") == name, F.col("score"))
    pair = lambda name: F.format_string("%.2f±%.2f", F.avg(of(name)) * 100, F.stddev_pop(of(name)) * 100).alias(name)
    head = every[0].union(every[1]).union(every[2]).agg(*map(pair, names))
    lists = lambda df, at, item: df.groupBy("graph_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, item.alias("x")))), lambda s: s["x"]), "").alias("value"))
    sols = lists(solutions, "pos", F.format_string("%d, ", "id"))
    ratio = lists(curves, "k", F.format_string("cnr=%.2f, ", "cnr"))
    parts = head.select(F.lit(0).alias("part"), F.lit(None).cast("long").alias("graph_id"), F.format_string("%s, CNR: %s, diff = %s", *names).alias("value"))
    parts = parts.union(sols.select(F.lit(1), "graph_id", "value")).union(head.select(F.lit(2), F.lit(None).cast("long"), F.lit(""))).union(ratio.select(F.lit(3), "graph_id", "value"))
    return parts.select(F.struct("part", "graph_id").alias("place"), "value")


def write_report(lines: DataFrame, path: str) -> None:
    """One text file of ``report``, in order."""
    lines.orderBy("place").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """``scores`` (dataset, solution, time) as a table of a column a dataset and two rows,
    the scores of the solutions and the times."""
    rows = scores.select("dataset", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.col("solution").alias("x")), F.struct(F.lit(1).alias("row"), F.col("time").alias("x")))).alias("r")).select("dataset", "r.*")
    rows.groupBy("row").pivot("dataset").agg(F.first("x")).orderBy("row").drop("row").coalesce(1).write.mode("overwrite").csv(path, header=True)
