"""Removal orders: adaptive centralities, cycle breaking, random, re-insertion.

All of these are sequential within a graph and run one task a graph.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import draw
from . import betweenness
from .cycles import adjacent, broken, neighbours
from .robustness import order_and_edges

Graph = dict[int, set[int]]
SOLUTION = "graph_id long, pos long, id long"
#: Bytes of the balls that grow at a time; vertices up to which they are searched one by one.
BALLS, SMALL = 1 << 23, 40
#: PageRanks that differ by less are ties; edges of whole components ranked in one task.
ALIKE, SHARE_EDGES = 1e-9, 20_000
#: Arcs that a block of sources looks at.
STEPS = 1 << 18
#: Scores of a component that differ by less, relatively, are equal; vertices of a component that is ordered alone.
EQUAL, ALONE = 1e-13, 200


def degree_scores(near: Graph) -> dict[int, float]:
    return {v: float(len(ws)) for v, ws in near.items()}


def betweenness_scores(near: Graph) -> dict[int, float]:
    """Shares of shortest paths through a vertex over ordered pairs, ends excluded,
    over (n - 1)(n - 2); nothing for fewer than three vertices. Levels forward,
    dependencies backward, from each source."""
    n, out = len(near), dict.fromkeys(near, 0.0)
    if n < 3:
        return out
    for s in near:
        depth, paths, order, todo = {s: 0}, dict.fromkeys(near, 0.0), [], deque([s])
        paths[s] = 1.0
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    todo.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if depth.get(v) == depth[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def closeness_scores(near: Graph) -> dict[int, float]:
    """(reached - 1) / distances, scaled by the share of vertices reached."""
    n, out = len(near), {}
    for s in near:
        depth, todo = {s: 0}, deque([s])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    todo.append(w)
        total, r = sum(depth.values()), len(depth) - 1
        out[s] = (r / total) * (r / (n - 1)) if total and n > 1 else 0.0
    return out


def hanging(near: Graph) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """(hung, size, degree) of a connected graph: the vertex that each vertex of a hanging
    tree hangs on, outer ones first; the vertices that hang on each, itself included; the
    degrees in what is left. Of a tree one vertex is left."""
    degree, size = {v: len(ws) for v, ws in near.items()}, dict.fromkeys(near, 1)
    hung: dict[int, int] = {}
    todo = [v for v, d in degree.items() if d == 1]
    while todo:
        v = todo.pop()
        if degree[v] != 1:
            continue  # the last of a tree
        p = next(w for w in near[v] if w not in hung)
        hung[v], degree[v] = p, 0
        size[p] += size[v]
        degree[p] -= 1
        if degree[p] == 1:
            todo.append(p)
    return hung, size, degree


def distance_sums(near: Graph) -> dict[int, int]:
    """The sum of a vertex's distances to all others, in a connected graph. Hanging trees
    are taken off, and get theirs from the vertex that they hang on; in the rest a ball
    around each vertex grows by a step a round. Balls are bits, a block of vertices at a
    time, so that a block takes about BALLS bytes; vertices that bear trees of one size
    share words, so that counts of bits give sums of weights."""
    hung, size, degree = hanging(near)
    below = dict.fromkeys(near, 0)
    for v, p in hung.items():
        below[p] += below[v] + size[v]
    core = sorted((v for v in near if v not in hung), key=degree.__getitem__, reverse=True)
    total, base = len(near), sum(below[v] for v in core)
    far = dict(zip(core, (grown_balls(core, near, size, degree) + base).tolist(), strict=True))
    for v, p in reversed(hung.items()):
        far[v] = far[p] + total - 2 * size[v]
    return far


def grown_balls(core: list[int], near: Graph, size: dict[int, int], degree: dict[int, int]) -> np.ndarray:
    """For each of ``core``, of falling ``degree`` among themselves, the sum over them of
    ``size`` times distance."""
    at = {v: i for i, v in enumerate(core)}
    n, out = len(core), np.zeros(len(core), dtype=np.int64)
    inner = [[at[w] for w in near[v] if w in at] for v in core]
    to = [np.array([ws[k] for ws in inner if len(ws) > k], dtype=np.int64) for k in range(degree[core[0]])]
    weight = np.array([size[v] for v in core], dtype=np.int64)
    by_weight = np.argsort(weight, kind="stable")
    same = np.flatnonzero(np.diff(weight[by_weight], prepend=-1))
    # word and bit of each vertex: words hold one weight only
    runs = np.diff(np.append(same, n))
    words = np.concatenate([[0], np.cumsum((runs + 63) // 64)])
    place = np.empty(n, dtype=np.int64)
    place[by_weight] = np.arange(n) - np.repeat(same - words[:-1] * 64, runs)
    word_weight = np.repeat(weight[by_weight[same]], np.diff(words)).astype(np.float64)
    held = max(1, BALLS // (8 * n))
    for a in range(0, int(words[-1]), held):
        b = min(a + held, int(words[-1]))
        own = np.flatnonzero((place >= a * 64) & (place < b * 64))
        ball = np.zeros((n, b - a), dtype=np.uint64)
        ball[own, place[own] // 64 - a] = np.uint64(1) << (place[own] % 64).astype(np.uint64)
        whole = int(weight[own].sum())
        while (left := whole - (np.bitwise_count(ball) @ word_weight[a:b]).astype(np.int64)).any():
            out += left
            new = ball.copy()
            for ws in to:
                new[: len(ws)] |= ball[ws]
            ball = new
    return out


def whole_closeness(near: Graph) -> dict[int, float]:
    """``closeness_scores`` of a connected graph."""
    if len(near) <= SMALL:
        return closeness_scores(near)
    r = len(near) - 1
    return {v: (r / x) * (r / r) for v, x in distance_sums(near).items()}


def whole_betweenness(near: Graph) -> dict[int, float]:
    """``betweenness_scores`` of a connected graph. Through a vertex go all paths between
    the trees that hang on it and from them to the rest; the others are those of the
    graph without its hanging trees, whose vertices count as often as they bear others."""
    n = len(near)
    if n <= SMALL:
        return betweenness_scores(near)
    hung, size, degree = hanging(near)
    own = {v: (n - 1) ** 2 - (n - size[v]) ** 2 for v in near}
    for v, p in hung.items():
        own[p] -= size[v] ** 2
    core = [v for v in near if v not in hung]
    out = dict(own)
    for v, x in zip(core, carried(core, near, size).tolist(), strict=True):
        out[v] += x
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def carried(core: list[int], near: Graph, size: dict[int, int]) -> np.ndarray:
    """``betweenness.carried`` from each of ``core``, weighted by ``size``."""
    at = {v: i for i, v in enumerate(core)}
    inner = [[at[w] for w in near[v] if w in at] for v in core]
    first = np.concatenate([[0], np.cumsum([len(ws) for ws in inner])]).astype(np.int64)
    flat = np.array([w for ws in inner for w in ws], dtype=np.int64)
    weight = np.array([size[v] for v in core], dtype=np.float64)
    return betweenness.carried(first, flat, weight, np.arange(len(core)), STEPS)


def pagerank_scores(near: Graph, damping: float = 0.85, tolerance: float = 1e-10, most: int = 200) -> dict[int, float]:
    n, at = len(near), {v: i for i, v in enumerate(near)}
    degree = np.array([len(ws) for ws in near.values()], dtype=np.int64)
    end, other = np.repeat(np.arange(n), degree), np.array([at[w] for ws in near.values() for w in ws], dtype=np.int64)
    rank, loose, shared = np.full(n, 1 / n if n else 0.0), degree == 0, np.maximum(degree, 1)
    for _ in range(most if n else 0):
        new = (1 - damping) / n + damping * (rank[loose].sum() / n + np.bincount(end, (rank / shared)[other], n))
        moved = np.abs(new - rank).sum()
        rank = new
        if moved < tolerance * n:
            break
    return dict(zip(near, rank.tolist(), strict=True))


SCORES: dict[str, Callable[[Graph], dict[int, float]]] = {"degree": degree_scores, "betweenness": betweenness_scores, "closeness": closeness_scores, "pagerank": pagerank_scores}


#: Scores of a vertex that depend on its component alone, but for a factor by the size
#: of the graph: 1 / the factor for n vertices.
WITHIN: dict[Callable, Callable[[int], int]] = {betweenness_scores: lambda n: (n - 1) * (n - 2), closeness_scores: lambda n: n - 1}


def reached(near: Graph, todo: list[int]) -> set[int]:
    seen = set(todo)
    while todo:
        new = near[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


def degree_order(near: Graph, most: int | None = None) -> list[int]:
    """The vertex of highest residual degree, ties to the least id, again and again. A
    heap of ids for each degree; a vertex that loses a neighbour enters the one below, and
    the highest degree only falls."""
    degree = {v: len(ws) for v, ws in near.items()}
    queue: list[list[int]] = [[] for _ in range(max(degree.values(), default=-1) + 1)]
    for v in sorted(near):
        queue[degree[v]].append(v)  # sorted, so a heap
    out: list[int] = []
    while queue and (most is None or len(out) < most):
        if not queue[-1]:
            queue.pop()
            continue
        v = heappop(queue[-1])
        if degree.get(v) != len(queue) - 1:
            continue  # gone, or in a lower heap by now
        del degree[v]
        out.append(v)
        for w in near[v]:
            if w in degree:
                degree[w] -= 1
                heappush(queue[degree[w]], w)
    return out


class PushedRank:
    """PageRank while vertices are removed, up to a factor that all vertices share: x with
    x = 1 + damping * (sum of x / degree over the neighbours). Teleports and the rank of
    isolated vertices are spread evenly, so x alone orders the ranks. A removal leaves
    residuals at the neighbours of its neighbours; they are pushed on from the last x until
    none is over ``tolerance``, so what a removal doesn't reach isn't touched. A component
    of at most ``direct`` vertices is solved at once instead."""

    def __init__(self, near: Graph, damping: float, tolerance: float, direct: int):
        self.ids = np.array(sorted(near), dtype=np.int64)
        at = {v: i for i, v in enumerate(self.ids.tolist())}
        self.near = [np.array([at[w] for w in near[v]], dtype=np.int64) for v in self.ids.tolist()]
        self.degree = np.array([len(ws) for ws in self.near], dtype=np.float64)
        self.first = np.concatenate([[0], np.cumsum(self.degree)]).astype(np.int64)
        self.flat = np.concatenate([*self.near, np.empty(0, dtype=np.int64)])
        self.there = np.ones(len(at), dtype=bool)
        self.damping, self.tolerance, self.direct = damping, tolerance, direct
        self.x, self.residual = np.zeros(len(at)), np.ones(len(at))
        self.push(np.arange(len(at)))

    def push(self, active: np.ndarray) -> None:
        x, residual, n = self.x, self.residual, len(self.x)
        while len(active):
            held = residual[active]
            x[active] += held
            residual[active] = 0
            size = self.first[active + 1] - self.first[active]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(self.first[active] - ends + size, size)
            to = self.flat[place]
            share = np.repeat(self.damping * held / np.maximum(self.degree[active], 1), size)
            if len(to) * 64 > n:
                residual += np.bincount(to, share, n)
                residual[~self.there] = 0
                active = np.flatnonzero(np.abs(residual) > self.tolerance)
            else:
                there = self.there[to]
                to = to[there]
                np.add.at(residual, to, share[there])
                touched = np.unique(to)
                active = touched[np.abs(residual[touched]) > self.tolerance]

    def solved(self, start: int) -> bool:
        """Solve the component of ``start``, unless it has over ``direct`` vertices."""
        at, todo, ends = {start: 0}, [start], []
        while todo:
            v = todo.pop()
            for w in self.near[v][self.there[self.near[v]]].tolist():
                if w not in at:
                    if len(at) == self.direct:
                        return False
                    at[w] = len(at)
                    todo.append(w)
                ends.append((at[w], at[v]))
        a, own = np.eye(len(at)), np.array(list(at), dtype=np.int64)
        for w, v in ends:
            a[w, v] = -self.damping / self.degree[own[v]]
        self.x[own], self.residual[own] = np.linalg.solve(a, np.ones(len(at))), 0
        return True

    def remove(self, v: int) -> None:
        self.there[v] = False
        near = self.near[v][self.there[self.near[v]]]
        self.residual[near] -= self.damping * self.x[v] / max(self.degree[v], 1)
        touched = [near]
        for u in near.tolist():
            d = self.degree[u]
            self.degree[u] = d - 1
            others = self.near[u][self.there[self.near[u]]]
            if len(others):
                self.residual[others] += self.damping * self.x[u] * (1 / (d - 1) - 1 / d)
                touched.append(others)
        self.x[v] = self.residual[v] = 0
        for u in near.tolist():
            if self.residual[u]:
                self.solved(u)
        touched = np.unique(np.concatenate(touched))
        self.push(touched[np.abs(self.residual[touched]) > self.tolerance])


def pagerank_order(near: Graph, most: int | None = None, damping: float = 0.85, tolerance: float = 1e-12, alike: float = ALIKE, direct: int = 100) -> list[int]:
    """The vertex of highest PageRank of the residual graph, again and again; ranks within
    ``alike`` of the mean rank are ties, which go to the least id."""
    return [v for v, _ in ranked_order(near, most, damping, tolerance, alike, direct)]


def ranked_order(near: Graph, most: int | None = None, damping: float = 0.85, tolerance: float = 1e-12, alike: float = ALIKE, direct: int = 100) -> list[tuple[int, float]]:
    """``pagerank_order`` with each vertex's rank (``PushedRank.x``) when it is removed."""
    ranks, out = PushedRank(near, damping, tolerance, direct), []
    while len(out) < len(near) and (most is None or len(out) < most):
        v = int(np.argmax(ranks.x >= ranks.x.max() - alike))  # ids rise
        out.append((int(ranks.ids[v]), float(ranks.x[v])))
        ranks.remove(v)
    return out


#: The same scores of a connected graph, in arrays.
WHOLE: dict[Callable, Callable[[Graph], dict[int, float]]] = {betweenness_scores: whole_betweenness, closeness_scores: whole_closeness}


def first_best(scores: np.ndarray) -> int:
    """The first of the highest scores, rounded to 12 decimals."""
    most = scores.max()
    best = round(float(most), 12)
    return next(i for i in np.flatnonzero(scores >= most - 2e-12).tolist() if round(float(scores[i]), 12) == best)


class Scored:
    """Scores of a graph while vertices are removed: ``kept`` of each of ``ids``, times
    ``over`` of its component's size, below 0 when gone; made anew where a removal can have
    changed them."""

    def __init__(self, near: Graph, score: Callable[[Graph], dict[int, float]]):
        self.near = {v: set(ws) for v, ws in near.items()}
        self.over, self.whole = WITHIN[score], WHOLE[score]
        self.ids = np.array(sorted(near), dtype=np.int64)
        self.kept = np.zeros(len(near))
        self.renew(set(near))

    def renew(self, touched: set[int]) -> None:
        while touched:
            part = reached(self.near, [next(iter(touched))])
            found = self.whole({v: self.near[v] for v in part})
            self.kept[np.searchsorted(self.ids, list(found))] = np.array(list(found.values())) * self.over(len(part))
            touched = touched - part

    def remove(self, at: int) -> int:
        self.kept[at], v = -1.0, int(self.ids[at])
        touched = self.near.pop(v)
        for w in touched:
            self.near[w].discard(v)
        self.renew(touched)
        return v


def adaptive(near: Graph, score: Callable[[Graph], dict[int, float]], most: int | None = None) -> list[int]:
    """Remove the best vertex of the residual graph, ties to the least id, ``most``
    times or until none is left. Degrees and PageRanks are kept up to date; other scores
    are made anew each time where the removal can have changed them."""
    if score is degree_scores:
        return degree_order(near, most)
    if score is pagerank_scores:
        return pagerank_order(near, most)
    left, out = Scored(near, score), []
    while left.near and (most is None or len(out) < most):
        out.append(left.remove(first_best(left.kept / max(left.over(len(left.near)), 1))))
    return out


def settled_order(near: Graph, score: Callable[[Graph], dict[int, float]], widest: int, most: int | None = None) -> list[tuple[int, float]] | None:
    """The order of a component, with each vertex's ``Scored.kept`` when it is removed. What
    ties by rounded scores depends on the size of the graph that is left; this is None if
    it can decide in any graph whose factor is at most ``widest``."""
    left, out = Scored(near, score), []
    while left.near and (most is None or len(out) < most):
        best = float(left.kept.max())
        close = np.flatnonzero(left.kept >= best - 2e-12 * widest)
        if (left.kept[close] < best * (1 - EQUAL)).any():
            return None
        at = int(close[left.kept[close] >= 0][0])
        out.append((left.remove(at), best))
    return out


def merged_order(settled: dict[int, list[tuple[int, float]]], open_parts: list[Graph], score: Callable[[Graph], dict[int, float]], most: int | None = None) -> list[int]:
    """``adaptive`` of a graph from the orders of its components; of those that have none
    (``open_parts``) the scores are made here."""
    over, out = WITHIN[score], []
    left = [Scored(near, score) for near in open_parts]
    n = sum(map(len, settled.values())) + sum(len(x.near) for x in left)
    places = dict.fromkeys(settled, 0)
    heads: dict[float, list[tuple[int, int]]] = {}  # by score: heaps of (vertex, component)
    undecided: dict[float, set[int]] = {}
    values: list[float] = []

    def enter(c: int) -> None:
        if places[c] < len(settled[c]):
            v, x = settled[c][places[c]]
            if x not in heads:
                heads[x] = []
                heappush(values, -x)
            heappush(heads[x], (v, c))

    def enter_open(i: int) -> None:
        if left[i].near:
            x = float(left[i].kept.max())
            if x not in undecided:
                undecided[x] = set()
                heappush(values, -x)
            undecided[x].add(i)

    for c in settled:
        enter(c)
    for i in range(len(left)):
        enter_open(i)
    while values and (most is None or len(out) < most):
        k = max(over(n), 1)
        top, best, seen = None, None, []
        while values:
            x = -values[0]
            if top is not None and (x / k < top / k - 2e-12 or round(x / k, 12) != round(top / k, 12)):
                break
            heappop(values)
            if seen and seen[-1] == x:
                continue
            if not heads.get(x):
                heads.pop(x, None)
            if not undecided.get(x):
                undecided.pop(x, None)
            if x not in heads and x not in undecided:
                continue
            top = x if top is None else top
            seen.append(x)
            if x in heads:
                v, c = heads[x][0]
                best = min(best or (v, x, c, -1), (v, x, c, -1))
            for i in undecided.get(x, ()):
                at = first_best(left[i].kept / k)
                best = min(best or (int(left[i].ids[at]), x, i, at), (int(left[i].ids[at]), x, i, at))
        for x in seen:
            heappush(values, -x)
        if best is None:
            break
        v, x, c, at = best
        out.append(v)
        n -= 1
        if at < 0:
            heappop(heads[x])
            places[c] += 1
            enter(c)
        else:
            undecided[x].discard(c)
            left[c].remove(at)
            enter_open(c)
    return out


def scored_shares(edges: DataFrame, score: Callable[[Graph], dict[int, float]], most: int | None = None) -> DataFrame:
    """``adaptive`` of each graph, for scores within components (WITHIN): the components are
    ordered apart, large ones in a task each, and merged by one task a graph, which also
    orders those whose ties the size of the graph decides."""
    from ..plans.derive import cut
    from .components import components

    held = cut(edges.select("graph_id", "src", "dst").distinct())
    ends = cut(held.select("graph_id", F.explode(F.array("src", "dst")).alias("id")).distinct())
    labels = cut(components(ends, held.where("src <> dst")))
    counts = ends.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = labels.groupBy("graph_id", "comp").agg(F.count(F.lit(1)).alias("size"))
    m = held.count()
    share = F.when(F.col("size") > ALONE, -1 - F.col("comp")).otherwise(F.pmod(F.xxhash64("graph_id", "comp"), F.lit(m // SHARE_EDGES + 1)))
    rows = held.join(labels.withColumnRenamed("id", "src"), ["graph_id", "src"]).join(sizes, ["graph_id", "comp"]).join(F.broadcast(counts), "graph_id")  # one row a graph
    rows = rows.select("graph_id", "comp", "src", "dst", "n", share.alias("share")).repartition(min(512, m // 1000 + 1), "graph_id", "share")
    kinds = "graph_id long, comp long, seq long, id long, other long, kept double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        widest, found = WITHIN[score](int(pdf.n.iloc[0])), []
        for comp, part in pdf.groupby("comp"):
            pairs = list(zip(part.src.tolist(), part.dst.tolist(), strict=True))
            order = settled_order(neighbours(pairs), score, widest, most)
            if order is None:
                found += [(comp, -1, u, v, 0.0) for u, v in pairs]
            else:
                found += [(comp, i, v, 0, x) for i, (v, x) in enumerate(order)]
        out = pd.DataFrame(found, columns=["comp", "seq", "id", "other", "kept"])
        out.insert(0, "graph_id", pdf.graph_id.iloc[0])
        return out

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf[pdf.seq >= 0].sort_values(["comp", "seq"])
        settled: dict[int, list[tuple[int, float]]] = {}
        for c, v, x in zip(done.comp.tolist(), done.id.tolist(), done.kept.tolist(), strict=True):
            settled.setdefault(c, []).append((v, x))
        parts = [neighbours(zip(p.id.tolist(), p.other.tolist(), strict=True)) for _, p in pdf[pdf.seq < 0].groupby("comp")]
        order = merged_order(settled, parts, score, most)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "pos": range(len(order)), "id": order}, columns=["graph_id", "pos", "id"])

    return cut(rows.groupBy("graph_id", "share").applyInPandas(run, kinds)).groupBy("graph_id").applyInPandas(merge, SOLUTION)


def per_graph(edges: DataFrame, fn: Callable[[Graph], list[int]]) -> DataFrame:
    """graph_id, pos, id of an order that ``fn`` makes of each graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = fn(neighbours(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True)))
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "pos": range(len(order)), "id": order}, columns=["graph_id", "pos", "id"])

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, SOLUTION)


def adaptive_order(edges: DataFrame, centrality: str, most: int | None = None) -> DataFrame:
    if centrality not in SCORES:
        raise ValueError(f"unknown centrality: {centrality}")
    if centrality == "pagerank":
        return pagerank_shares(edges, most)
    if SCORES[centrality] in WITHIN:
        return scored_shares(edges, SCORES[centrality], most)
    return per_graph(edges, lambda near: adaptive(near, SCORES[centrality], most))


def pagerank_shares(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``pagerank_order`` of each graph. The ranks of a component don't depend on the others,
    so the components of a large graph are dealt to shares of about SHARE_EDGES edges,
    ordered apart and merged: of the shares' next vertices the one of highest rank is next,
    ties to the least id. So all of a share that ranks above its least rank so far comes
    at once after it, and of equal least ranks the greater of the ids so far waits."""
    from pyspark.sql import Window

    from ..plans.derive import cut
    from .components import components

    held = cut(edges.select("graph_id", "src", "dst"))
    shares = (held.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0) // SHARE_EDGES + 1
    if shares == 1:
        return per_graph(held, lambda near: pagerank_order(near, most))
    ends = held.select("graph_id", F.explode(F.array("src", "dst")).alias("id"))
    labels = components(ends, held).withColumnRenamed("id", "src")
    share = F.pmod(F.xxhash64("comp"), F.lit(shares)).cast("int").alias("share")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = ranked_order(neighbours(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True)), most)
        x = np.array([r for _, r in found])
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "share": pdf.share.iloc[0], "seq": range(len(found)), "id": [v for v, _ in found], "x": x, "least": np.minimum.accumulate(x)})

    rows = held.join(labels, ["graph_id", "src"]).select("graph_id", share, "src", "dst")
    rows = cut(rows.groupBy("graph_id", "share").applyInPandas(run, "graph_id long, share int, seq long, id long, x double, least double"))
    levels = rows.select("graph_id", "least").distinct()
    fall = Window.partitionBy("graph_id").orderBy(F.desc("least"))
    levels = levels.withColumn("fell", F.coalesce(F.lag("least").over(fall) - F.col("least") > ALIKE, F.lit(True)).cast("long")).withColumn("level", F.sum("fell").over(fall)).drop("fell")
    so_far = Window.partitionBy("graph_id", "share", "level").orderBy("seq")
    waits = F.max(F.when(F.col("x") <= F.col("least") + ALIKE, F.col("id"))).over(so_far)
    order = Window.partitionBy("graph_id").orderBy("level", "waits", "seq")
    out = rows.join(levels, ["graph_id", "least"]).withColumn("waits", waits)
    out = out.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "id")
    return out if most is None else out.where(F.col("pos") < most)


def decycle_order(edges: DataFrame, most: int | None = None) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.stack([pdf.src.to_numpy(), pdf.dst.to_numpy()], axis=1)
        order = broken(np.unique(ends), ends, most)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "pos": range(len(order)), "id": order}, columns=["graph_id", "pos", "id"])

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, SOLUTION)


def random_order(vertices: DataFrame, seed: int = 0) -> DataFrame:
    """A fixed shuffle by ``functions.draw`` of (seed, graph, id)."""
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy(draw(seed, F.col("graph_id"), F.col("id")), "id")
    return vertices.select("graph_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "id")


def centrality(edges: DataFrame, name: str) -> DataFrame:
    """graph_id, id, score."""
    score = SCORES[name]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = score(neighbours(zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True)))
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "id": list(found), "score": list(found.values())})

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, "graph_id long, id long, score double")


# Scores of putting a vertex back: from the sizes of the components that it touches.
STRATEGIES: dict[str, Callable[[list[int]], int]] = {
    "count": len,
    "rank": lambda sizes: 1 + sum(sizes),
    "multiple": lambda sizes: (1 + sum(sizes)) * len(sizes),
}


class Growing:
    """Components that vertices are put back into: their sizes and, for each, the vertices
    still out that touch it. Of two that merge the lesser border moves. ``first`` and
    ``flat``: the places of each vertex's neighbours, as views of arrays. The border of a
    component of one vertex is read off them; only merged ones hold a set."""

    def __init__(self, first: memoryview, flat: memoryview, out: np.ndarray):
        n = len(first) - 1
        self.first, self.flat = first, flat
        self.out = bytearray(out.astype(np.uint8).tobytes())
        self.root, self.size = array("i", range(n)), array("i", [0]) * n  # size 0: not there
        self.border: dict[int, set[int]] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def near(self, v: int) -> memoryview:
        return self.flat[self.first[v] : self.first[v + 1]]

    def add(self, v: int) -> None:
        """``v`` as a component of its own."""
        self.out[v], self.size[v] = 0, 1

    def edge(self, r: int) -> set[int]:
        """The border of the component ``r``, which is taken from it."""
        held = self.border.pop(r, None)
        return {w for w in self.near(r) if self.out[w]} if held is None else held

    def join(self, v: int) -> set[int]:
        """Merge ``v`` with the components around it; gives the vertices that touched more
        than one of them."""
        both: set[int] = set()
        for w in self.near(v):
            if self.size[w]:
                a, b = self.find(v), self.find(w)
                if a != b:
                    kept, moved = self.edge(a), self.edge(b)
                    if len(kept) < len(moved):
                        a, b, kept, moved = b, a, moved, kept
                    both |= moved & kept
                    kept |= moved
                    self.border[a] = kept
                    self.root[b] = a
                    self.size[a] += self.size[b]
        held = self.border.get(self.find(v))
        if held is not None:
            held.discard(v)
        both.discard(v)
        return both

    def around(self, v: int) -> list[int]:
        """Sizes of the components that ``v`` touches."""
        return [self.size[r] for r in {self.find(w) for w in self.near(v) if self.size[w]}]


def reinsertion(near: Graph, solution: list[int], strategy: str = "rank", each: int = 1, merge_residual: bool = False) -> list[int]:
    """The solution reordered: vertices are put back in rounds, the ``each`` of least
    (score, id) first, and the last put back is removed first. Vertices outside the
    solution are there from the start, singletons unless ``merge_residual``.

    A heap has scores that are no more than the true ones: a score falls only where a
    vertex touched two components that merge, and those are renewed at once; where it
    rose, that shows when the vertex comes up, and it goes back."""
    ends = np.array([(u, v) for u, ws in near.items() for v in ws if u < v], dtype=np.int64).reshape(-1, 2)
    return put_back(np.array(sorted({*near, *solution}), dtype=np.int64), ends, np.array(solution, dtype=np.int64), strategy, each, merge_residual)


def put_back(ids: np.ndarray, edges: np.ndarray, solution: np.ndarray, strategy: str, each: int, merge_residual: bool) -> list[int]:
    """``reinsertion`` of arrays: the ids in order, the edges (two columns), the solution."""
    if each < 1:
        raise ValueError("each must be at least 1")
    score = STRATEGIES[strategy]
    left = np.zeros(len(ids), dtype=bool)
    left[np.searchsorted(ids, solution)] = True
    grown = Growing(*adjacent(ids, edges), left)
    there = np.flatnonzero(~left).tolist()
    for v in there:
        grown.add(v)
    if merge_residual:
        for v in there:
            grown.join(v)
    known = {v: score(grown.around(v)) for v in np.flatnonzero(left).tolist()}  # of those left
    heap = [(s, v) for v, s in known.items()]
    heapify(heap)
    out: list[int] = []
    while known:
        taken: list[int] = []
        while heap and len(taken) < each:
            s, v = heappop(heap)
            if s != known.get(v):
                continue
            now = score(grown.around(v))
            if now == s:
                taken.append(v)
                del known[v]
            else:
                known[v] = now
                heappush(heap, (now, v))
        for v in taken:
            grown.add(v)
            for w in grown.join(v):
                if w in known:
                    known[w] = score(grown.around(w))
                    heappush(heap, (known[w], w))
            out.append(v)
    return ids[np.array(out[::-1], dtype=np.int64)].tolist()


def reinsert_order(edges: DataFrame, solution: DataFrame, strategy: str = "rank", step_ratio: float = 0.001, merge_residual: bool = False) -> DataFrame:
    """graph_id, pos, id after re-insertion in batches of step_ratio * n."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    rows = edges.select("graph_id", F.lit(1).alias("kind"), F.col("src").alias("x"), F.col("dst").alias("y")).union(solution.select("graph_id", F.lit(0), "pos", "id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sol, ends = order_and_edges(pdf)
        ids = np.unique(ends)
        n = len(ids)
        order = put_back(np.union1d(ids, sol), ends, sol, strategy, max(1, int(step_ratio * n)), merge_residual)
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "pos": np.arange(len(order)), "id": order}, columns=["graph_id", "pos", "id"])

    return rows.groupBy("graph_id").applyInPandas(run, SOLUTION)


def reinsert_scores(arcs: DataFrame, labels: DataFrame, removals: DataFrame) -> DataFrame:
    """graph_id, id, count, rank, multiple of one round; ``labels``: components of the
    residual graph."""
    sizes = labels.groupBy("graph_id", "comp").agg(F.count(F.lit(1)).alias("size"))
    near = arcs.join(removals.select("graph_id", F.col("id").alias("src")).distinct(), ["graph_id", "src"]).join(labels.withColumnRenamed("id", "dst"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("id"), "comp").distinct()
    got = near.join(sizes, ["graph_id", "comp"]).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    out = removals.select("graph_id", "id").distinct().join(got, ["graph_id", "id"], "left").na.fill(0)
    return out.select("graph_id", "id", F.col("c").alias("count"), (F.col("s") + 1).alias("rank"), (F.col("c") * (F.col("s") + 1)).alias("multiple"))


#: Strategies of re-insertion by number; 0 leaves a solution as it is.
STRATEGY_IDS = {1: "count", 2: "rank", 3: "multiple"}


def evaluate_solution(edges: DataFrame, solution: DataFrame, vertices: DataFrame, counts: DataFrame, strategy_id: int = 0, step_ratio: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(scores, curve) of a given ``solution`` (graph_id, pos, id): graph_id, robustness;
    graph_id, k, pairs, conn. It is re-inserted by the strategy first, if any; vertices
    that it leaves out are removed last, in order of id."""
    from pyspark.sql import Window

    from .robustness import robustness_curve, robustness_score

    if strategy_id not in {0, *STRATEGY_IDS}:
        raise ValueError(f"unknown strategy: {strategy_id}")
    sol = solution.select("graph_id", "pos", "id")
    if strategy_id:
        sol = reinsert_order(edges, sol, STRATEGY_IDS[strategy_id], step_ratio)
    given = sol.groupBy("graph_id").agg(F.count(F.lit(1)).alias("given"))
    rest = vertices.join(sol.select("graph_id", "id"), ["graph_id", "id"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("graph_id").orderBy("id")))
    rest = rest.join(F.broadcast(given), "graph_id", "left").select("graph_id", (F.coalesce("given", F.lit(0)) + F.col("r") - 1).cast("long").alias("pos"), "id")  # one row a graph
    curve = robustness_curve(sol.union(rest), edges, counts)
    return robustness_score(curve, counts), curve
