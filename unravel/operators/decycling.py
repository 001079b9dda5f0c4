"""The share of vertices on cycles while a solution is removed, and what follows: the
steps of an episode and prefixes of a solution."""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .robustness import later_neighbours, order_and_edges


class Blocks:
    """Blocks of a growing graph that no bridge parts. Trees of blocks hang together by
    bridges; an edge between two blocks of a tree merges the path between them. A vertex
    is on a cycle if its block has other vertices."""

    def __init__(self, n: int):
        self.block, self.tree, self.up = array("i", range(n)), array("i", range(n)), array("i", [-1]) * n
        self.size, self.weight, self.on_cycles = array("i", [1]) * n, array("i", [1]) * n, 0

    @staticmethod
    def find(root: array, x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def above(self, b: int) -> int:
        """The block above ``b``, or -1."""
        return -1 if self.up[b] < 0 else self.find(self.block, self.up[b])

    def hang(self, child: int, parent: int) -> None:
        """Turn the tree of ``child`` so that it is the root, and hang it below."""
        while child >= 0:
            after = self.above(child)
            self.up[child] = parent
            parent, child = child, after

    def add(self, u: int, v: int) -> None:
        a, b = self.find(self.block, u), self.find(self.block, v)
        if a == b:
            return
        s, t = self.find(self.tree, a), self.find(self.tree, b)
        if s != t:
            if self.weight[s] > self.weight[t]:
                a, b, s, t = b, a, t, s
            self.hang(a, b)
            self.tree[s] = t
            self.weight[t] += self.weight[s]
            return
        seen, x, y = set(), a, b
        while True:  # both ends climb in turn, so the path costs what it is long
            if x >= 0:
                if x in seen:
                    meet = x
                    break
                seen.add(x)
                x = self.above(x)
            x, y = y, x
        path = [meet]
        for end in (a, b):
            while end != meet:
                path.append(end)
                end = self.above(end)
        top = self.up[meet]
        for x in path:
            self.on_cycles -= self.size[x] if self.size[x] > 1 else 0
        for x in path[1:]:
            self.block[x] = meet
            self.size[meet] += self.size[x]
        self.up[meet] = top
        self.on_cycles += self.size[meet]


def cyclic_counts(ids: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """counts[k]: vertices on cycles among ids[k:], by adding the vertices in reverse."""
    return counted(ids, edges).tolist()


def counted(ids, edges) -> np.ndarray:
    """``cyclic_counts`` of and as arrays."""
    first, near = later_neighbours(ids, edges)
    blocks, out = Blocks(len(ids)), np.zeros(len(ids), dtype=np.int64)
    for k in range(len(ids) - 1, -1, -1):
        for b in near[first[k] : first[k + 1]]:
            blocks.add(k, b)
        out[k] = blocks.on_cycles
    return out


def cycle_ratio_curve(solution: DataFrame, edges: DataFrame, counts: DataFrame, residual: bool = False) -> DataFrame:
    """graph_id, k, id (the vertex removed next), cyclic, cnr: vertices on cycles once the
    first k of ``solution`` (graph_id, pos, id) are gone, over all vertices or, if
    ``residual``, those left. One task a graph, near-linear in its edges; its rows must fit
    in the task. Vertices outside of the solution count as removed."""
    rows = solution.select("graph_id", F.lit(0).alias("kind"), F.col("pos").alias("x"), F.col("id").alias("y")).union(edges.select("graph_id", F.lit(1), "src", "dst"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, edges = order_and_edges(pdf)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "k": np.arange(len(ids)), "id": ids, "cyclic": counted(ids, edges)})

    out = rows.groupBy("graph_id").applyInPandas(run, "graph_id long, k long, id long, cyclic long")
    whole = F.col("n") - F.col("k") if residual else F.col("n")
    return out.join(F.broadcast(counts), "graph_id").select("graph_id", "k", "id", "cyclic", (F.col("cyclic") / whole).alias("cnr"))  # one row a graph


def episode_steps(curve: DataFrame) -> DataFrame:
    """graph_id, step, action, reward, terminal of removing a solution up to the first
    state without a cycle: the reward is the fall of the cycle ratio."""
    w = Window.partitionBy("graph_id").orderBy("k")
    after = F.coalesce(F.lead("cnr").over(w), F.lit(0.0))
    steps = curve.select("graph_id", F.col("k").alias("step"), F.col("id").alias("action"), "cnr", (F.col("cnr") - after).alias("reward"), (after == 0).alias("terminal"))
    return steps.where("cnr > 0").drop("cnr")


def prefix_above(curve: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``curve`` (graph_id, k, id, cnr) before the first whose cnr is below
    ``threshold``: the prefix of the solution that it takes to get there."""
    w = Window.partitionBy("graph_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return curve.withColumn("least", F.min("cnr").over(w)).where(F.col("least") >= threshold).drop("least")
