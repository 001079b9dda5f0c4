"""Bridges, vertices on cycles, the 2-core, and removals that break cycles.

A vertex is on a cycle if it has an edge that is no bridge.
"""

from __future__ import annotations

from array import array
from collections import deque
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.derive import both_ways, cut

EDGE = "graph_id long, src long, dst long"


def bridge_pairs(near: dict[int, set[int]]) -> set[tuple[int, int]]:
    """The bridges (u < v) of a simple graph, by entry times and low points, with a
    stack of its own."""
    entry: dict[int, int] = {}
    low: dict[int, int] = {}
    out = set()
    for root in near:
        if root in entry:
            continue
        entry[root] = low[root] = len(entry)
        path = [(root, None, iter(near[root]))]
        while path:
            v, parent, rest = path[-1]
            for w in rest:
                if w not in entry:
                    entry[w] = low[w] = len(entry)
                    path.append((w, v, iter(near[w])))
                    break
                if w != parent:
                    low[v] = min(low[v], entry[w])
            else:
                path.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > entry[parent]:
                        out.add((min(v, parent), max(v, parent)))
    return out


def neighbours(pairs) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def cyclic(near: dict[int, set[int]]) -> set[int]:
    cut_edges = bridge_pairs(near)
    return {v for v, ws in near.items() if any((min(v, w), max(v, w)) not in cut_edges for w in ws)}


def bridges(edges: DataFrame) -> DataFrame:
    """graph_id, src, dst of the bridges; one task a graph. ``forest.bridges`` is the
    distributed form for a large graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sorted(bridge_pairs(neighbours(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True))))
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "src": [u for u, _ in found], "dst": [v for _, v in found]}, columns=["graph_id", "src", "dst"])

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, EDGE)


def cycle_vertices(edges: DataFrame) -> DataFrame:
    """graph_id, id of the vertices on cycles."""
    held = edges.select("graph_id", "src", "dst").join(bridges(edges), ["graph_id", "src", "dst"], "left_anti")
    return held.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct()


def two_core(edges: DataFrame) -> DataFrame:
    """graph_id, id: what is left after vertices of degree under two are peeled off."""
    e = cut(edges.select("graph_id", "src", "dst", "edge_id", "value"))
    while True:
        few = both_ways(e).groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("d")).where("d < 2").select("graph_id", F.col("src").alias("id"))
        few = cut(few)
        if not few.limit(1).count():
            return both_ways(e).select("graph_id", F.col("src").alias("id")).distinct()
        for end in ("src", "dst"):
            e = e.join(few.withColumnRenamed("id", end), ["graph_id", end], "left_anti")
        e = cut(e)


def cycle_ratio(on_cycles: DataFrame, counts: DataFrame) -> DataFrame:
    """graph_id, n, cyclic, cnr: the share of vertices that ``on_cycles`` (graph_id, id) has."""
    c = on_cycles.groupBy("graph_id").agg(F.count(F.lit(1)).alias("cyclic"))
    return counts.join(c, "graph_id", "left").select("graph_id", "n", F.coalesce("cyclic", F.lit(0)).alias("cyclic"), F.when(F.col("n") > 0, F.coalesce("cyclic", F.lit(0)) / F.col("n")).alias("cnr"))


def on_cycle(near: dict[int, set[int]], v: int) -> bool:
    """Whether two neighbours of ``v`` are connected without it. A search from each
    takes a step in turn, until two meet or all but one have ended, so the cost is that
    of the lesser parts."""
    if len(near[v]) < 2:
        return False
    owner = {v: v} | {w: w for w in near[v]}
    searches = [(w, deque([w])) for w in near[v]]
    while len(searches) > 1:
        left = []
        for w, todo in searches:
            x = todo.popleft()
            for y in near[x]:
                if y not in owner:
                    owner[y] = w
                    todo.append(y)
                elif owner[y] != w and y != v:
                    return True
            if todo:
                left.append((w, todo))
        searches = left
    return False


def adjacent(ids: np.ndarray, edges: np.ndarray) -> tuple[memoryview, memoryview]:
    """(first, flat): flat[first[v]:first[v + 1]] are the places in ``ids``, which rise, of the
    neighbours of vertex v. Arrays of 32 bits, for a graph is held by one task."""
    n = len(ids)
    a, b = np.searchsorted(ids, edges[:, 0]), np.searchsorted(ids, edges[:, 1])
    pair = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    a, b = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    first = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(a, minlength=n), out=first[1:])
    return memoryview(first), memoryview(b[np.argsort(a, kind="stable")])


class Left:
    """What is left of a graph held as arrays: near[v] are the neighbours of v that are
    there, live[v] their number."""

    def __init__(self, first: memoryview, flat: memoryview):
        self.first, self.flat = first, flat
        self.live = array("i", np.diff(first).astype(np.int32).tobytes())
        self.there = bytearray([1]) * (len(first) - 1)

    def __getitem__(self, v: int) -> list[int]:
        return [w for w in self.flat[self.first[v] : self.first[v + 1]] if self.there[w]]

    def drop(self, v: int) -> list[int]:
        """Take ``v`` out; gives the neighbours that it had."""
        touched = self[v]
        self.there[v] = 0
        for w in touched:
            self.live[w] -= 1
        return touched


def break_cycles(near: dict[int, set[int]], most: int | None = None) -> list[int]:
    """Repeatedly the vertex on a cycle with the highest residual degree, ties to the
    least id, until no cycle is left."""
    ends = np.array([(u, v) for u, ws in near.items() for v in ws if u < v], dtype=np.int64).reshape(-1, 2)
    return broken(np.array(sorted(near), dtype=np.int64), ends, most)


def broken(ids: np.ndarray, edges: np.ndarray, most: int | None = None) -> list[int]:
    """``break_cycles`` of arrays: the ids in order and the edges (two columns).

    A heap holds vertices by degree, renewed as neighbours go. Vertices that can't lie on
    a cycle are peeled off between; the first of the rest is searched around, and one
    that is found on no cycle never is again."""
    near, n = Left(*adjacent(ids, edges)), len(ids)
    degree = array("i", near.live)  # peeled neighbours count

    def peel(todo: list[int]) -> None:
        while todo:
            v = todo.pop()
            if near.there[v] and near.live[v] < 2:
                todo += near.drop(v)

    peel(np.flatnonzero(np.frombuffer(near.live, dtype=np.int32) < 2).tolist())
    top = max(degree, default=0)
    rank = lambda v: (top - degree[v]) * n + v  # noqa: E731 - one number, by degree and then id
    heap = [rank(v) for v in range(n) if near.there[v]]
    heapify(heap)
    out: list[int] = []
    while heap and (most is None or len(out) < most):
        d, v = divmod(heappop(heap), n)
        if not near.there[v] or top - d != degree[v] or not on_cycle(near, v):
            continue
        touched = near.drop(v)
        for w in touched:
            degree[w] -= 1
            heappush(heap, rank(w))
        out.append(v)
        peel(touched)
    return ids[np.array(out, dtype=np.int64)].tolist()
