"""Connected components and what follows from their sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from ..plans.derive import cut, drop


#: Edges that are few enough to be settled by one task, whatever the input's size was.
FEW = 200_000


def merged(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, up: the least vertex that each vertex of ``edges``, FEW at most, reaches."""
    columns = [*keys, "src", "dst"]
    kinds = ", ".join(f"{n} {edges.schema[c].dataType.simpleString()}" for n, c in [*((k, k) for k in keys), ("id", "src"), ("up", "src")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for part in batches:
            for *key, u, v in zip(*(part[c].tolist() for c in columns), strict=True):
                a, b = find((*key, u)), find((*key, v))
                if a != b:
                    root[max(a, b)] = min(a, b)
        yield pd.DataFrame([(*x, find(x)[-1]) for x in list(root)], columns=[*keys, "id", "up"])

    return edges.select(*columns).coalesce(1).mapInPandas(run, kinds)


def contracted(edges: DataFrame, keys: Sequence[str], cut: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None], near: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(keys, id, comp): the least id that each vertex of ``edges`` (keys, src, dst; a table
    of ``cut``, which stays) reaches; and the table of ``cut`` that this reads. ``cut``
    writes a round's table and rereads it; ``drop`` deletes one.

    A round draws a rank for each vertex, takes of a vertex and its neighbours the one of
    least rank, goes on from that once more, and contracts the vertices along what they
    took. On a path about a third is left, on hubs less, so all rounds together cost about
    half as much again as the first; vertices without edges take no part. What has at most
    FEW edges is merged by one task. The names come back through the rounds' tables.
    """
    keys, steps, live, left = list(keys), [], edges, edges.count()
    while left > FEW:
        rank = lambda c: F.xxhash64(F.lit(len(steps)), c)
        ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("id"), F.col("src").alias("to")))
        least = live.where("src <> dst").select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").groupBy(*keys, "id").agg(F.min(F.struct(rank(F.col("to")).alias("rank"), F.col("to").alias("up"))).alias("low"))
        one = least.select(*keys, "id", F.least(F.struct(rank(F.col("id")).alias("rank"), F.col("id").alias("up")), "low")["up"].alias("up"))
        two = cut(one.join(one.select(*keys, F.col("id").alias("up"), F.col("up").alias("top")), [*keys, "up"]).select(*keys, "id", F.col("top").alias("up")))
        steps.append(two)
        to = lambda end: near(two.select(*keys, F.col("id").alias(end), F.col("up").alias(f"u_{end}")))
        ahead = live.join(to("src"), [*keys, "src"]).join(to("dst"), [*keys, "dst"]).where("u_src <> u_dst").select(*keys, F.least("u_src", "u_dst").alias("src"), F.greatest("u_src", "u_dst").alias("dst")).distinct()
        size = Observation()
        after = cut(ahead.observe(size, F.count(F.lit(1)).alias("n")))
        if live is not edges:
            drop(live)
        live, left = after, size.get.get("n") or 0
    known = cut(merged(live, keys))
    if live is not edges:
        drop(live)
    for step in reversed(steps):
        over = near(known.select(*keys, F.col("id").alias("up"), F.col("up").alias("top")))
        after = cut(step.join(over, [*keys, "up"], "left").select(*keys, "id", F.coalesce("top", "up").alias("up")))
        drop(step)
        drop(known)
        known = after
    names = known.groupBy(*keys, "up").agg(F.min("id").alias("comp"))
    return known.join(names, [*keys, "up"]).select(*keys, "id", "comp"), known


def settled(labels: DataFrame, arcs: DataFrame, keys: Sequence[str], cut: Callable[[DataFrame], DataFrame], drop: Callable[[DataFrame], None], near: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(keys, id, comp): the least id that each vertex of ``labels`` (keys, id) reaches over
    ``arcs`` (keys, src, dst, each edge both ways), which it contracts (``contracted``)."""
    keys = list(keys)
    edges = cut(arcs.where("src < dst").select(*keys, "src", "dst"))
    found, known = contracted(edges, keys, cut, drop, near)
    out = cut(labels.select(*keys, "id").join(near(found), [*keys, "id"], "left").select(*keys, "id", F.coalesce("comp", "id").alias("comp")))
    for table in (edges, known):
        drop(table)
    return out


def components(vertices: DataFrame, edges: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """keys, id, comp: the least id that a vertex reaches, in all graphs at once."""
    keys = list(keys)
    held = cut(edges.select(*keys, "src", "dst"))
    found, known = contracted(held, keys, cut, drop)
    out = cut(vertices.select(*keys, "id").distinct().join(found, [*keys, "id"], "left").select(*keys, "id", F.coalesce("comp", "id").alias("comp")))
    for table in (held, known):
        drop(table)
    return out


def component_sizes(labels: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    return labels.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("size"))


def residual_score(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """graph_id, score: connected pairs of a residual graph, by its ``labels``, over all
    pairs of the graph (``counts``: graph_id, n); 0 if nothing is left."""
    pairs = connectivity(labels).select("graph_id", "pairs")
    whole = F.col("n") * (F.col("n") - 1) / 2
    return counts.join(pairs, "graph_id", "left").select("graph_id", F.when(whole > 0, F.coalesce("pairs", F.lit(0)) / whole).otherwise(0.0).alias("score"))


def connectivity(labels: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """keys, n, components, largest, pairs (connected pairs), ratio (largest / n)."""
    s = component_sizes(labels, keys)
    out = s.groupBy(*keys).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), (F.sum(F.col("size") * (F.col("size") - 1)) / 2).cast("long").alias("pairs"))
    return out.withColumn("ratio", F.col("largest") / F.col("n"))
