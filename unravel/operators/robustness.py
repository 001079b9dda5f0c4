"""Connectivity while vertices are removed in order."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.derive import cut, drop
from .components import connectivity, contracted


class UnionFind:
    """Components that grow; ``pairs`` are the connected pairs. Eight bytes a vertex."""

    def __init__(self, n: int):
        self.root, self.size, self.pairs = array("i", range(n)), array("i", [1]) * n, 0

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            if self.size[x] < self.size[y]:
                x, y = y, x
            self.pairs += self.size[x] * self.size[y]
            self.root[y] = x
            self.size[x] += self.size[y]


def places(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place in ``ids``, distinct, of each of ``values``, or -1."""
    if not len(ids):
        return np.full(len(values), -1, dtype=np.int32)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    at = np.minimum(np.searchsorted(ids, values, sorter=order), len(ids) - 1)
    found = order[at]
    found[ids[found] != values] = -1
    return found


def later_neighbours(ids, edges) -> tuple[memoryview, memoryview]:
    """(first, near): near[first[k]:first[k + 1]] are the places over k in ``ids`` that
    ``edges`` (pairs, or an array of two columns) link to k: known once k, the earlier of the
    two, is added in reverse. Ends outside of ``ids`` have no place. Arrays of 32 bits, for
    a graph is held by one task."""
    ids = np.asarray(ids, dtype=np.int64)
    e = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
    a, b = places(ids, e[:, 0]), places(ids, e[:, 1])
    held = (a >= 0) & (b >= 0) & (a != b)
    a, b = a[held], b[held]
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low, kind="stable")
    first = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum(np.bincount(low, minlength=len(ids)), out=first[1:])
    return memoryview(first), memoryview(np.ascontiguousarray(high[order]))


def curve_of(ids, edges) -> np.ndarray:
    """curve[k]: connected pairs among ids[k:], over n (n - 1) / 2; by adding the
    vertices in reverse."""
    first, near = later_neighbours(ids, edges)
    sets, out = UnionFind(len(ids)), np.zeros(len(ids))
    for k in range(len(ids) - 1, -1, -1):
        for b in near[first[k] : first[k + 1]]:
            sets.join(k, b)
        out[k] = sets.pairs
    return out


def order_and_edges(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The vertices (kind 0) by x, and the edges (kind 1), of rows (kind, x, y)."""
    kind, x, y = pdf.kind.to_numpy(), pdf.x.to_numpy(), pdf.y.to_numpy()
    return y[kind == 0][np.argsort(x[kind == 0], kind="stable")], np.stack([x[kind == 1], y[kind == 1]], axis=1)


def robustness_curve(solution: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """graph_id, k, pairs, conn for every k; one task a graph, whose rows must fit in
    it. Vertices outside the solution count as removed. ``forest.curve`` is the
    distributed form for a large graph."""
    rows = solution.select("graph_id", F.lit(0).alias("kind"), F.col("pos").alias("x"), F.col("id").alias("y")).union(edges.select("graph_id", F.lit(1), "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = curve_of(*order_and_edges(pdf))
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "k": np.arange(len(out)), "pairs": out})

    out = rows.groupBy("graph_id").applyInPandas(run, "graph_id long, k long, pairs double")
    return out.join(F.broadcast(counts), "graph_id").select("graph_id", "k", F.col("pairs").cast("long").alias("pairs"), F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1) / 2)).alias("conn"))


def checkpoints(solution: DataFrame, edges: DataFrame, counts: DataFrame, steps: int = 10) -> tuple[DataFrame, DataFrame]:
    """(graph_id, k, id) and (graph_id, k, edge_id, src, dst): what is left at every
    ceil(n / steps)-th k. An edge lives while k <= the lesser of its ends' positions."""
    step = F.ceil(F.col("n") / steps)
    s = solution.join(F.broadcast(counts), "graph_id").select("graph_id", "id", "pos", step.alias("step"))
    alive = s.select("graph_id", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pos"), F.col("step"))).alias("k"))
    e = edges.join(s.select("graph_id", F.col("id").alias("src"), F.col("pos").alias("ps"), "step"), ["graph_id", "src"]).join(s.select("graph_id", F.col("id").alias("dst"), F.col("pos").alias("pd")), ["graph_id", "dst"])
    return alive, e.select("graph_id", "edge_id", "src", "dst", F.explode(F.sequence(F.lit(0).cast("long"), F.least("ps", "pd"), F.col("step"))).alias("k"))


def checkpointed_curve(solution: DataFrame, edges: DataFrame, counts: DataFrame, steps: int = 10) -> DataFrame:
    """The curve at the ``checkpoints``, whose components converge together. Vertices
    without an edge have no pairs, so only those with one are rows."""
    keys = ["graph_id", "k"]
    held = cut(checkpoints(solution, edges, counts, steps)[1].select(*keys, "src", "dst"))
    pairs = connectivity(contracted(held, keys, cut, drop)[0], keys).select(*keys, "pairs")
    ks = counts.where("n > 0").select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.ceil(F.col("n") / steps))).alias("k"))
    return ks.join(pairs, keys, "left").select(*keys, F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs")).join(F.broadcast(counts), "graph_id").select(*keys, "pairs", F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1) / 2)).alias("conn"))


def robustness_score(curve: DataFrame, counts: DataFrame) -> DataFrame:
    """graph_id, robustness: the curve's sum without k = 0, over n."""
    total = curve.groupBy("graph_id").agg(F.coalesce(F.sum(F.when(F.col("k") > 0, F.col("conn"))), F.lit(0.0)).alias("total"))
    return total.join(F.broadcast(counts), "graph_id").select("graph_id", (F.col("total") / F.col("n")).alias("robustness"))
