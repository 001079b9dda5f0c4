"""Independent cascades with given draws: live edges joined to seeds."""

from __future__ import annotations

from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import edge_draw
from ..plans.derive import cut
from .components import components

KEYS = ("graph_id", "sim")
#: Vertices times simulations that a task orders, unless they hang together.
SHARE_ROWS = 200_000


def live_edges(edges: DataFrame, sims: int) -> DataFrame:
    """graph_id, sim, src, dst of edges whose draw is below their value."""
    e = edges.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))))
    return e.where(edge_draw(F.col("src"), F.col("dst"), F.col("sim")) < F.col("value")).select("graph_id", "sim", "src", "dst")


def live_components(vertices: DataFrame, edges: DataFrame, sims: int) -> DataFrame:
    v = vertices.select("graph_id", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))).alias("sim"))
    return components(v, live_edges(edges, sims), KEYS)


def influenced(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose component holds a seed."""
    hit = labels.join(seeds.select("graph_id", "id"), ["graph_id", "id"]).select(*KEYS, "comp").distinct()
    return labels.join(hit, [*KEYS, "comp"], "left_semi")


def spread(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph_id, sim, spread."""
    return influenced(labels, seeds).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("spread"))


def mean_spread(labels: DataFrame, seeds: DataFrame, sims: int) -> DataFrame:
    """graph_id, spread: the mean over simulations, cut to an integer."""
    return spread(labels, seeds).groupBy("graph_id").agg(F.floor(F.sum("spread") / sims).cast("double").alias("spread"))


def candidates(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph_id, id, free: 1 where simulation 0 doesn't reach the vertex."""
    one = labels.where("sim = 0")
    hit = influenced(one, seeds).select("graph_id", "id", F.lit(0).alias("f"))
    return one.join(hit, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("f", F.lit(1)).cast("long").alias("free"))


def influence_robustness(labels: DataFrame, solution: DataFrame, counts: DataFrame, sims: int) -> DataFrame:
    """graph_id, robustness: seeds join in the solution's order; the mean over the
    prefixes of spread / n, each spread cut to an integer.

    A component counts for all prefixes from its first seed on, so one row a
    component replaces one run a prefix.
    """
    first = labels.join(solution.select("graph_id", "id", "pos"), ["graph_id", "id"], "left").groupBy(*KEYS, "comp").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("size")).where("pos is not null")
    steps = first.groupBy("graph_id", "pos").agg(F.sum("size").alias("grown"))
    run = F.sum("grown").over(Window.partitionBy("graph_id").orderBy("pos"))
    prefix = solution.select("graph_id", "pos").join(steps, ["graph_id", "pos"], "left").na.fill(0).select("graph_id", "pos", F.floor(run / sims).alias("spread"))
    return prefix.groupBy("graph_id").agg(F.sum("spread").alias("total")).join(F.broadcast(counts), "graph_id").select("graph_id", (F.col("total") / F.col("n") / F.col("n")).alias("robustness"))


def one_round(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    """graph_id, id: what the seeds reach in one step of simulation 0, without them."""
    s = seeds.select("graph_id", F.col("id").alias("src")).distinct()
    hit = arcs.join(s, ["graph_id", "src"]).where(edge_draw(F.least("src", "dst"), F.greatest("src", "dst"), F.lit(0)) < F.col("value"))
    return hit.select("graph_id", F.col("dst").alias("id")).distinct().join(seeds.select("graph_id", "id"), ["graph_id", "id"], "left_anti")


def influence_action(labels: DataFrame) -> DataFrame:
    """graph_id, id, gain: the vertex that influences most vertices over all simulations,
    ties to the least id."""
    sizes = labels.groupBy(*KEYS, "comp").agg(F.count(F.lit(1)).alias("size"))
    gains = labels.join(sizes, [*KEYS, "comp"]).groupBy("graph_id", "id").agg(F.sum("size").alias("gain"))
    best = gains.groupBy("graph_id").agg(F.max(F.struct("gain", (-F.col("id")).alias("least"))).alias("b"))
    return best.select("graph_id", (-F.col("b.least")).alias("id"), F.col("b.gain").alias("gain"))


def lazy_greedy(parts: dict[int, list[int]], size: dict[int, int], most: int | None = None) -> list[tuple[int, int]]:
    """(vertex, gain) of the greatest gain, ties to the least id, until none gains: the
    sizes of a vertex's ``parts`` that no earlier one has."""
    ids = sorted(parts)
    at = {p: i for i, p in enumerate(size)}
    many = np.array([len(parts[v]) for v in ids], dtype=np.int64)
    flat = np.array([at[p] for v in ids for p in parts[v]], dtype=np.int32)
    places, gains = greedy_places(np.concatenate([[0], np.cumsum(many)]), flat, np.array(list(size.values()), dtype=np.int64), most)
    return [(ids[i], g) for i, g in zip(places, gains, strict=True)]


def greedy_places(first: np.ndarray, flat: np.ndarray, size: np.ndarray, most: int | None = None) -> tuple[array, array]:
    """``lazy_greedy`` of arrays: the parts of v are flat[first[v] : first[v + 1]]. A gain only
    falls, so one that is renewed and still first in the heap is the greatest; others stay as
    they are."""
    left, n = size.copy(), len(first) - 1
    gain = np.bincount(np.repeat(np.arange(n), np.diff(first)), size[flat], n).astype(np.int64)
    # a heap entry is one number, the gain that is missing to the greatest and the vertex
    top = int(gain.max(initial=0))
    heap = ((top - gain) * n + np.arange(n)).tolist()
    heapify(heap)
    out, gains = array("q"), array("q")
    while heap and (most is None or len(out) < most):
        missing, v = divmod(heappop(heap), n)
        own = flat[first[v] : first[v + 1]]
        now = int(left[own].sum())
        if now != top - missing:
            if now:
                heappush(heap, (top - now) * n + v)
            continue
        out.append(v)
        gains.append(now)
        left[own] = 0
    return out, gains


def influence_order(labels: DataFrame, most: int | None = None, share_rows: int = SHARE_ROWS) -> DataFrame:
    """graph_id, pos, id, gain: vertices by their marginal influence, greedily, until all
    vertices are influenced in every simulation.

    Vertices that no simulation joins, over others either, don't change each other's gains,
    so such groups are dealt to shares of about ``share_rows`` vertices and simulations, one
    task each. In a share's order gains fall, and ids rise where they are equal: one that had
    the gain and a lesser id would have been before. So the whole order is that of all
    shares' rows by gain and id."""
    held = cut(labels.select(*KEYS, "id", "comp"))
    links = cut(held.where("comp <> id").select("graph_id", F.col("comp").alias("src"), F.col("id").alias("dst")).distinct())
    groups = components(held.select("graph_id", "id").distinct(), links).select("graph_id", "id", F.col("comp").alias("reach"))
    shares = held.count() // share_rows + 1
    rows = held.join(groups, ["graph_id", "id"]).select(*KEYS, "id", "comp", F.pmod(F.xxhash64("graph_id", "reach"), F.lit(shares)).alias("share"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.groupby(["sim", "comp"]).ngroup().to_numpy().astype(np.int32)
        ids, at = np.unique(pdf.id.to_numpy(), return_inverse=True)
        places, gains = greedy_places(np.concatenate([[0], np.cumsum(np.bincount(at))]), part[np.argsort(at, kind="stable")], np.bincount(part), most)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "id": ids[np.array(places, dtype=np.int64)], "gain": np.array(gains, dtype=np.int64)})

    found = cut(rows.groupBy("graph_id", "share").applyInPandas(run, "graph_id long, id long, gain long"))
    order = Window.partitionBy("graph_id").orderBy(F.desc("gain"), "id")
    out = found.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "id", "gain")
    return out if most is None else out.where(F.col("pos") < most)
