"""Betweenness of large graphs, by levels.

Breadth-first searches from a block of sources advance together: a row is a vertex that a
source's search has reached, with its level and its number of shortest paths. A level is a
join of the last one with the arcs and a sum; what it must not enter again lies in the
last two levels. Dependencies come back level by level, each a join and a sum. A block's
tables have at most as many rows as vertices times ``block`` sources; the blocks bound
them, not the work, which is that of one search a vertex.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from ..plans.derive import cut, drop
from .components import components

#: Sources of a graph that are searched at once.
BLOCK = 64
#: ``by_sources``: sources of a task, tasks of a component at most, edges of whole components in a task.
EACH, MOST_PARTS, SHARE_EDGES = 512, 256, 20_000
#: Arcs that a block of sources looks at.
STEPS = 1 << 18


def searched(arcs: DataFrame, sources: DataFrame, keys: list[str]) -> list[DataFrame]:
    """The levels of the searches from ``sources`` (keys, source): tables of ``cut`` with
    keys, source, id, paths."""
    levels = [cut(sources.select(*keys, "source", F.col("source").alias("id"), F.lit(1.0).alias("paths")))]
    step = arcs.select(*keys, F.col("src").alias("id"), F.col("dst").alias("next"))
    while True:
        ahead = levels[-1].join(step, [*keys, "id"]).groupBy(*keys, "source", F.col("next").alias("id")).agg(F.sum("paths").alias("paths"))
        for seen in levels[-2:]:
            ahead = ahead.join(seen.select(*keys, "source", "id"), [*keys, "source", "id"], "left_anti")
        size = Observation()
        ahead = cut(ahead.observe(size, F.count(F.lit(1)).alias("n")))
        if not size.get.get("n"):
            drop(ahead)
            return levels
        levels.append(ahead)


def dependencies(levels: list[DataFrame], arcs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, share: what the vertices beyond the sources get of the shortest paths of
    the searches. Drops the levels."""
    at = [*keys, "source", "id"]
    step = arcs.select(*keys, F.col("src").alias("next"), F.col("dst").alias("id"))
    total, below = None, None
    for here in reversed(levels):
        if below is None:
            with_share = here.withColumn("share", F.lit(0.0))
        else:
            # Of a vertex's paths and what lies behind it, each vertex before it gets the part that comes through it.
            out = below.select(*keys, "source", F.col("id").alias("next"), ((1 + F.col("share")) / F.col("paths")).alias("each")).join(step, [*keys, "next"])
            back = out.groupBy(*at).agg(F.sum("each").alias("each"))
            with_share = here.join(back, at, "left").select(*at, "paths", (F.col("paths") * F.coalesce("each", F.lit(0.0))).alias("share"))
        below = cut(with_share)
        drop(here)
        part = below.where("id <> source").groupBy(*keys, "id").agg(F.sum("share").alias("share"))
        total = part if total is None else total.union(part)
    return total.groupBy(*keys, "id").agg(F.sum("share").alias("share"))


def betweenness(edges: DataFrame, block: int = BLOCK, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """keys, id, score of every vertex of ``edges`` (keys, src, dst): shares of shortest
    paths through it over ordered pairs, ends left out, over (n - 1)(n - 2); 0 in graphs
    of fewer than three vertices."""
    keys = list(keys)
    ends = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arcs = cut(edges.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*").distinct())
    vertices = cut(arcs.select(*keys, F.col("src").alias("id")).distinct())
    counts = vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("n")).first().n or 0
    blocks = -(-most // block)
    total = vertices.select(*keys, "id", F.lit(0.0).alias("share"))
    for b in range(blocks):
        sources = vertices.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select(*keys, F.col("id").alias("source"))
        total = total.union(cut(dependencies(searched(arcs, sources, keys), arcs, keys)))
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return total.groupBy(*keys, "id").agg(F.sum("share").alias("share")).join(counts, keys).select(*keys, "id", F.when(pairs > 0, F.col("share") / pairs).otherwise(0.0).alias("score"))


def hanging_arrays(first: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hung, size): the vertex that each vertex of a hanging tree hangs on, -1 for the rest;
    the vertices that hang on each, itself included. The neighbours of v are
    flat[first[v] : first[v + 1]], one at least. Of a tree one vertex is left."""
    degree = np.diff(first).tolist()
    left = np.bitwise_xor.reduceat(flat, first[:-1]).tolist()  # of one neighbour that is left, its place
    hung, size = [-1] * len(degree), [1] * len(degree)
    todo = [v for v, d in enumerate(degree) if d == 1]
    while todo:
        v = todo.pop()
        if degree[v] != 1:
            continue  # the last of a tree
        p = left[v]
        hung[v], degree[v] = p, 0
        size[p] += size[v]
        left[p] ^= v
        degree[p] -= 1
        if degree[p] == 1:
            todo.append(p)
    return np.array(hung, dtype=np.int64), np.array(size, dtype=np.int64)


def carried(first: np.ndarray, flat: np.ndarray, weight: np.ndarray, sources: np.ndarray, steps: int) -> np.ndarray:
    """For each vertex the share of shortest paths from ``sources`` through it, ends left out,
    each path as often as the product of the ``weight`` of its ends. A block of sources is
    searched at once, level by level; it has about ``steps`` arcs to look at."""
    n, degree = len(first) - 1, np.diff(first)
    out, held = np.zeros(n), max(1, steps // max(len(flat), 1))
    for a in range(0, len(sources), held):
        block = sources[a : a + held]
        count = len(block)
        new, mark = np.ones(count * n, dtype=bool), np.zeros(count * n, dtype=np.int64)
        paths, share = np.zeros(count * n), np.zeros(count * n)
        front = np.arange(count) * n + block
        new[front], paths[front], levels = False, 1.0, []
        while len(front):
            v = front % n
            many = degree[v]
            ends = np.cumsum(many)
            key = np.repeat(front - v, many) + flat[np.arange(ends[-1]) + np.repeat(first[v] - ends + many, many)]
            go = new[key]
            key, of = key[go], np.repeat(front, many)[go]
            np.add.at(paths, key, paths[of])
            new[key] = False
            levels.append((of, key))
            order = np.arange(len(key))
            mark[key] = order
            front = key[mark[key] == order]
        for of, key in reversed(levels):
            np.add.at(share, of, paths[of] * ((weight[key % n] + share[key]) / paths[key]))
        share = share.reshape(count, n)
        share[np.arange(count), block] = 0
        out += weight[block] @ share
    return out


def by_sources(edges: DataFrame, each: int = EACH, most: int = MOST_PARTS, share_edges: int = SHARE_EDGES) -> DataFrame:
    """``betweenness`` of graphs whose components' edges fit in a task each. Paths stay in a
    component: those of a graph are dealt to shares of about ``share_edges`` edges, and the sources
    of a larger one over tasks, ``each`` a task but in no more than ``most`` of them. Hanging trees
    are counted, the rest is searched, its vertices counting as often as they bear others."""
    held = cut(edges.select("graph_id", "src", "dst").where("src <> dst").distinct())
    ends = cut(edges.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct())
    labels = cut(components(ends, held))
    counts = ends.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = labels.groupBy("graph_id", "comp").agg(F.least(F.ceil(F.count(F.lit(1)) / each), F.lit(most)).cast("int").alias("parts"))
    shares = held.count() // share_edges + 1
    share = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("graph_id", "comp"), F.lit(shares))).otherwise(-1 - F.col("comp"))
    rows = held.join(labels.withColumnRenamed("id", "src"), ["graph_id", "src"]).join(sizes, ["graph_id", "comp"])
    rows = rows.select("graph_id", "comp", "src", "dst", "parts", share.alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, parts = int(pdf.part.iloc[0]), int(pdf.parts.iloc[0])
        ids, at = np.unique(np.concatenate([pdf.src, pdf.dst]), return_inverse=True)
        n, u, v = len(ids), at[: len(pdf)], at[len(pdf) :]
        comp = np.empty(n, dtype=np.int64)
        comp[u] = comp[v] = pdf.comp.to_numpy()
        arcs = np.unique(np.stack([np.concatenate([u, v]), np.concatenate([v, u])]), axis=1)
        first = np.searchsorted(arcs[0], np.arange(n + 1))
        hung, size = hanging_arrays(first, arcs[1])
        total = np.zeros(n)
        if part == 0:
            _, which, all_of = np.unique(comp, return_inverse=True, return_counts=True)
            whole, off = all_of[which].astype(np.float64), hung >= 0
            total = (whole - 1) ** 2 - (whole - size) ** 2
            total -= np.bincount(hung[off], size[off].astype(np.float64) ** 2, n)
        inner = (hung[arcs[0]] < 0) & (hung[arcs[1]] < 0)
        arcs = arcs[:, inner]
        core = np.unique(arcs[0])
        core = core[np.argsort(comp[core], kind="stable")]
        place = np.full(n, -1, dtype=np.int64)
        place[core] = np.arange(len(core))
        arcs = place[arcs]
        arcs = arcs[:, np.argsort(arcs[0], kind="stable")]
        begin = np.searchsorted(arcs[0], np.arange(len(core) + 1))
        bounds = np.append(np.flatnonzero(np.diff(comp[core], prepend=-1 - abs(int(comp.min())))), len(core))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = core[a:b]
            total[own] += carried(begin[a : b + 1] - begin[a], arcs[1, begin[a] : begin[b]] - a, size[own].astype(np.float64), np.arange(part, b - a, parts), STEPS)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "id": ids, "share": total})

    found = rows.groupBy("graph_id", "share", "part").applyInPandas(run, "graph_id long, id long, share double")
    found = found.union(ends.select("graph_id", "id", F.lit(0.0)))  # those of loops alone, too
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return found.groupBy("graph_id", "id").agg(F.sum("share").alias("share")).join(F.broadcast(counts), "graph_id").select("graph_id", "id", F.when(pairs > 0, F.col("share") / pairs).otherwise(0.0).alias("score"))  # one row a graph
