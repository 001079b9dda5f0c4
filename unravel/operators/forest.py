"""Spanning forests of large graphs, and what they tell: bridges, cycles, merge trees.

No graph is held by one task. A forest is grown by Boruvka's phases: each component takes
the best edge that leaves it, and components are contracted along what they took, by
pointers that double. A phase at least halves the components, so there are at most log2 n
phases of log2 n rounds; the graphs of the tests take 4 to 6 phases of 2 to 4.

Bridges: every edge outside of the forest has a random label of 128 bits, every forest
edge the XOR of the labels of those whose cycle it lies on. That is the XOR over the
vertices on one side of it, and found by contracting the trees from their leaves and along
their paths. A forest edge is a bridge if its label is 0; it is taken for one by mistake
with probability 2 ** -128.

Merge trees: edges join components in falling order. A component of a phase and the edge
that it takes bound a chain: the edges within it that come before. Each forest edge climbs
from the component that it made to the first whose edge comes later, and lies in its
chain; sizes are summed from the lowest chains up, and along the chains.

``keys`` name the graph: all graphs, and states of a graph, are done at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..plans.derive import cut, drop

#: Edges of a contracted tree that are few enough for one task.
FEW = 200_000


@dataclass
class Forest:
    """picks (keys, phase, comp, death, edge_id, up): in each phase, the edge that a
    component took and the component that it became."""

    picks: DataFrame
    phases: int


def _both(df: DataFrame, *keep: str) -> DataFrame:
    """An arc (comp, to) each way for each edge of ``df``."""
    ends = F.array(F.struct(F.col("src").alias("comp"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("comp"), F.col("src").alias("to")))
    return df.select(*keep, F.explode(ends).alias("e")).select(*keep, "e.*")


def rooted(up: DataFrame, keys: list[str]) -> DataFrame:
    """keys, comp, up: pointers of ``up``, a table of ``cut``, followed to their ends, where
    up = comp. The steps double each round."""
    while True:
        over = up.select(*keys, F.col("comp").alias("up"), F.col("up").alias("top"))
        moves = Observation()
        after = cut(up.join(over, [*keys, "up"]).observe(moves, F.count_if(F.expr("top <> up")).alias("n")).select(*keys, "comp", F.col("top").alias("up")))
        drop(up)
        up = after
        if not moves.get.get("n"):
            return up


def boruvka(edges: DataFrame, keys: Sequence[str] = ("graph_id",)) -> Forest:
    """The maximum spanning forest of ``edges`` (keys, edge_id, src, dst, death) by
    (death, edge_id)."""
    keys = list(keys)
    live = cut(edges.where("src <> dst").select(*keys, "src", "dst", "death", "edge_id"))
    found, phase = None, 0
    while True:
        size = Observation()
        best = _both(live, *keys, "death", "edge_id").groupBy(*keys, "comp").agg(F.max(F.struct("death", "edge_id", "to")).alias("b"))
        taken = cut(best.select(*keys, "comp", "b.*").observe(size, F.count(F.lit(1)).alias("n")))
        if not size.get.get("n"):
            break
        # Two components that took the same edge would point to each other.
        back = taken.select(*keys, F.col("comp").alias("to"), F.col("to").alias("back"))
        first = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to"))
        up = rooted(cut(taken.join(back, [*keys, "to"]).select(*keys, "comp", F.when(first, F.col("comp")).otherwise(F.col("to")).alias("up"))), keys)
        row = cut(taken.join(up, [*keys, "comp"]).select(*keys, F.lit(phase).alias("phase"), "comp", "death", "edge_id", "up"))
        end = lambda c: up.select(*keys, F.col("comp").alias(c), F.col("up").alias(f"u_{c}"))
        left = live.join(end("src"), [*keys, "src"]).join(end("dst"), [*keys, "dst"])
        after = cut(left.where("u_src <> u_dst").select(*keys, F.col("u_src").alias("src"), F.col("u_dst").alias("dst"), "death", "edge_id"))
        for table in (live, taken, up):
            drop(table)
        live, phase = after, phase + 1
        found = row if found is None else found.union(row)
    drop(live)
    if found is None:
        found = taken.select(*keys, F.lit(0).alias("phase"), "comp", "death", "edge_id", F.col("comp").alias("up"))
    return Forest(found, phase)


def _lasting(tree: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edge_id, x1, x2 of each edge of the forest ``tree`` (keys, edge_id, src, dst;
    FEW edges at most): the XOR of ``sums`` (keys, at, x1, x2) on one side of it. One task,
    from the leaves up."""
    columns = [*keys, "kind", "a", "b", "c"]
    rows = tree.select(*keys, F.lit(0).alias("kind"), F.col("edge_id").cast("long").alias("a"), F.col("src").cast("long").alias("b"), F.col("dst").cast("long").alias("c"))
    # Sums of vertices that the tree hasn't would be read for nothing.
    on = tree.select(*keys, F.explode(F.array("src", "dst")).alias("at")).distinct()
    rows = rows.union(sums.join(on, [*keys, "at"], "left_semi").select(*keys, F.lit(1), F.col("at").cast("long"), "x1", "x2"))
    kinds = "".join(f"{k} {tree.schema[k].dataType.simpleString()}, " for k in keys) + "edge_id long, x1 long, x2 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[tuple, dict[tuple, int]] = {}
        own: dict[tuple, tuple[int, int]] = {}
        for part in batches:
            for *key, kind, a, b, c in zip(*(part[x].tolist() for x in columns), strict=True):
                if kind:
                    own[(*key, a)] = (b, c)
                else:
                    u, v = (*key, b), (*key, c)
                    near.setdefault(u, {})[v] = a
                    near.setdefault(v, {})[u] = a
        out, todo = [], [v for v, ws in near.items() if len(ws) == 1]
        while todo:
            v = todo.pop()
            if len(near[v]) == 1:
                ((w, edge),) = near.pop(v).items()
                x, y = own.get(v, (0, 0)), own.get(w, (0, 0))
                out.append((*v[:-1], edge, *x))
                own[w] = (x[0] ^ y[0], x[1] ^ y[1])
                del near[w][v]
                if len(near[w]) == 1:
                    todo.append(w)
        yield pd.DataFrame(out, columns=[*keys, "edge_id", "x1", "x2"])

    return rows.coalesce(1).mapInPandas(run, kinds)


def crossed(tree: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, edge_id, x1, x2 of each edge of the forest ``tree`` (keys, edge_id, src, dst;
    a table of ``cut``): the XOR of ``sums`` (keys, at, x1, x2) over the vertices on one
    side of it. The sums of a tree XOR to 0, so the side doesn't matter.

    The tree is contracted in rounds. A leaf goes with its edge, whose XOR is the leaf's
    own, and a vertex of two edges goes if no neighbour goes first: its second edge
    differs from its first by its own XOR, so one stands for both. What it has moves to a
    neighbour. A round takes a part of the vertices, so that all rounds cost little more
    than the first few; what has at most FEW edges is done by one task. Then the edges that
    went get their XOR from those that stood for them, the last first."""
    live, left, steps, own = tree, tree.count(), [], cut(sums)
    while left > FEW:
        degree = live.select(*keys, F.explode(F.array("src", "dst")).alias("at")).groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("d"))
        order = F.struct(F.least("d", F.lit(3)).alias("d"), F.xxhash64(F.lit(len(steps)), "at").alias("rank"), F.col("at"))
        degree = degree.select(*keys, "at", order.alias("o"))
        both = live.join(degree.select(*keys, F.col("at").alias("src"), F.col("o").alias("o_src")), [*keys, "src"]).join(degree.select(*keys, F.col("at").alias("dst"), F.col("o").alias("o_dst")), [*keys, "dst"])
        first = F.col("o_src") < F.col("o_dst")
        rows = both.select(*keys, F.when(first, F.col("o_src")).otherwise(F.col("o_dst")).alias("o"), F.struct("edge_id", F.when(first, F.col("dst")).otherwise(F.col("src")).alias("to")).alias("e")).where("o.d < 3")
        goes = rows.groupBy(*keys, F.col("o.at").alias("at")).agg(F.max("o.d").alias("d"), F.count(F.lit(1)).alias("n"), F.min("e").alias("one"), F.max("e").alias("two")).where("n = d")
        goes = goes.join(own, [*keys, "at"], "left").select(*keys, "at", "d", "one", "two", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("x1", "x2")))
        step = cut(goes)
        steps.append(step)
        moved = step.where("x1 <> 0 OR x2 <> 0").select(*keys, F.col("two.to").alias("at"), "x1", "x2")
        after = own.join(step.select(*keys, "at"), [*keys, "at"], "left_anti").select(*keys, "at", "x1", "x2").union(moved)
        after = cut(after.groupBy(*keys, "at").agg(*(F.bit_xor(x).alias(x) for x in ("x1", "x2"))).where("x1 <> 0 OR x2 <> 0"))
        drop(own)
        own = after
        gone = step.select(*keys, F.explode(F.array("one.edge_id", "two.edge_id")).alias("edge_id")).distinct()
        new = step.where("d = 2").select(*keys, F.col("one.edge_id").alias("edge_id"), F.col("one.to").alias("src"), F.col("two.to").alias("dst"))
        size = Observation()
        rest = live.join(gone, [*keys, "edge_id"], "left_anti").select(*keys, "edge_id", "src", "dst").union(new)
        rest = cut(rest.observe(size, F.count(F.lit(1)).alias("n")))
        if live is not tree:
            drop(live)
        live, left = rest, size.get.get("n") or 0
    known = cut(_lasting(live, own, keys))
    for step in reversed(steps):
        leaves = step.where("d = 1").select(*keys, F.col("one.edge_id").alias("edge_id"), "x1", "x2")
        stood = known.select(*keys, "edge_id", F.col("x1").alias("y1"), F.col("x2").alias("y2"))
        series = step.where("d = 2").select(*keys, F.col("one.edge_id").alias("edge_id"), F.col("two.edge_id").alias("other"), "x1", "x2").join(stood, [*keys, "edge_id"])
        series = series.select(*keys, F.col("other").alias("edge_id"), *(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}")).alias(f"x{i}") for i in (1, 2)))
        after = cut(known.union(leaves).union(series))
        drop(known)
        known = after
    return known


def bridges(edges: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """keys, edge_id, src, dst of the bridges of simple graphs ``edges`` (keys, edge_id,
    src, dst)."""
    keys = list(keys)
    e = cut(edges.select(*keys, "edge_id", "src", "dst"))
    forest = boruvka(e.withColumn("death", F.xxhash64("edge_id")), keys)  # any forest will do; drawn deaths make short chains
    kept = forest.picks.select(*keys, "edge_id").distinct()
    tree = cut(e.join(kept, [*keys, "edge_id"]).select(*keys, "edge_id", "src", "dst"))
    rest = e.join(kept, [*keys, "edge_id"], "left_anti")
    labels = [F.xxhash64(F.lit(i), "edge_id").alias(f"x{i}") for i in (1, 2)]
    ends = rest.select(*keys, *labels, F.explode(F.array("src", "dst")).alias("at"))
    sums = ends.groupBy(*keys, "at").agg(*(F.bit_xor(f"x{i}").alias(f"x{i}") for i in (1, 2)))
    whole = crossed(tree, sums, keys).where("x1 = 0 AND x2 = 0")
    return tree.join(whole.select(*keys, "edge_id"), [*keys, "edge_id"]).select(*keys, "edge_id", "src", "dst")


def cycle_vertices(edges: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """keys, id of the vertices with an edge that is no bridge."""
    keys = list(keys)
    held = edges.select(*keys, "edge_id", "src", "dst").join(bridges(edges, keys).select(*keys, "edge_id"), [*keys, "edge_id"], "left_anti")
    return held.select(*keys, F.explode(F.array("src", "dst")).alias("id")).distinct()


def cycle_ratio_checkpoints(solution: DataFrame, edges: DataFrame, counts: DataFrame, steps: int = 10) -> DataFrame:
    """graph_id, k, cyclic, cnr at every ceil(n / steps)-th k of ``solution``: the vertices
    on cycles once its first k are gone, over all; all checkpoints at once."""
    from .robustness import checkpoints

    alive, live = checkpoints(solution, edges, counts, steps)
    on = cycle_vertices(live, ("graph_id", "k")).groupBy("graph_id", "k").agg(F.count(F.lit(1)).alias("cyclic"))
    ks = alive.select("graph_id", "k").distinct().join(on, ["graph_id", "k"], "left").na.fill(0)
    return ks.join(F.broadcast(counts), "graph_id").select("graph_id", "k", "cyclic", F.when(F.col("n") > 0, F.col("cyclic") / F.col("n")).alias("cnr"))  # one row a graph


def running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str) -> DataFrame:
    """``df`` with before and upto: sums of ``value`` over the rows of the same keys that
    come earlier, without and with the row; ``bucket`` rises with ``order``. A key's rows
    are summed by bucket first, so that no task takes them all."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("s"))
    whole = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("s").over(whole), F.lit(0)).alias("base"))
    own = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("own", F.sum(value).over(own)).join(sums, [*keys, bucket])
    return out.withColumn("upto", F.col("base") + F.col("own")).withColumn("before", F.col("upto") - F.col(value)).drop("base", "own")


def merge_gains(vertices: DataFrame, edges: DataFrame, width: DataFrame, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """keys, edge_id, death, gain: the pairs of vertices that each edge of the maximum
    spanning forest connects, if edges come in falling order of (death, edge_id).
    ``width`` (keys, width): the span of deaths that is summed at a time."""
    keys = list(keys)
    forest = boruvka(edges, keys)
    picks = forest.picks
    tree = cut(picks.groupBy(*keys, "edge_id").agg(F.max("death").alias("death"), F.max("phase").alias("phase"), F.max("up").alias("node")))
    order = lambda p="": F.struct(f"{p}death", f"{p}edge_id")
    chains, climbing = None, None
    for level in range(1, forest.phases + 1):
        here = tree.where(F.col("phase") == level - 1).select(*keys, "edge_id", "death", "node")
        here = here if climbing is None else here.union(climbing)
        over = picks.where(F.col("phase") == level).select(*keys, F.col("comp").alias("node"), F.col("death").alias("p_death"), F.col("edge_id").alias("p_edge_id"), "up")
        at = cut(here.join(over, [*keys, "node"], "left").withColumn("stays", F.col("up").isNull() | (order() > order("p_"))))
        done = at.where("stays").select(*keys, F.lit(level).alias("level"), "node", "edge_id", "death")
        chains = done if chains is None else chains.union(done)
        climbing = at.where(~F.col("stays")).select(*keys, "edge_id", "death", F.col("up").alias("node"))
    if chains is None:
        return tree.select(*keys, "edge_id", "death", F.lit(0).cast("long").alias("gain"))
    chains = cut(chains)
    branches = None
    for level in range(forest.phases):
        if level == 0:
            sizes = vertices.select(*keys, F.col("id").alias("node"), F.lit(1).cast("long").alias("size"))
        else:
            sizes = chains.where(F.col("level") == level).join(branches, [*keys, "edge_id"]).groupBy(*keys, "node").agg(F.sum("size").alias("size"))
        took = picks.where(F.col("phase") == level).select(*keys, F.col("comp").alias("node"), "edge_id")
        now = cut(took.join(sizes, [*keys, "node"]).select(*keys, "edge_id", "size"))
        branches = now if branches is None else branches.union(now)
    pairs = lambda c: (c * (c - 1) / 2).cast("long")
    each = branches.groupBy(*keys, "edge_id").agg(F.sum("size").alias("size"), F.sum(pairs(F.col("size"))).alias("inner"))
    rows = chains.join(each, [*keys, "edge_id"]).join(width, keys)
    rows = rows.withColumn("bucket", -F.floor(F.col("death") / F.col("width")))
    rows = running(rows, [*keys, "level", "node"], "bucket", [F.desc("death"), F.desc("edge_id")], "size")
    return rows.select(*keys, "edge_id", "death", (pairs(F.col("upto")) - pairs(F.col("before")) - F.col("inner")).alias("gain"))


def curve(solution: DataFrame, edges: DataFrame, counts: DataFrame) -> DataFrame:
    """graph_id, k, pairs, conn for every k, as ``robustness.robustness_curve``, with no
    graph in one task: an edge dies with the first of its ends that ``solution`` (graph_id,
    pos, id) removes, and the pairs after k removals are the gains of all edges that die
    no earlier than k."""
    place = lambda end: solution.select("graph_id", F.col("id").alias(end), F.col("pos").alias(f"p_{end}"))
    e = edges.join(place("src"), ["graph_id", "src"]).join(place("dst"), ["graph_id", "dst"]).select("graph_id", "edge_id", "src", "dst", F.least("p_src", "p_dst").alias("death"))
    width = F.broadcast(counts.select("graph_id", F.ceil(F.sqrt("n")).alias("width")))  # one row a graph
    gains = merge_gains(solution.select("graph_id", "id"), e, width)
    by_k = gains.groupBy("graph_id", F.col("death").alias("k")).agg(F.sum("gain").alias("gain"))
    ks = solution.select("graph_id", F.col("pos").alias("k")).join(by_k, ["graph_id", "k"], "left").na.fill(0).join(width, "graph_id")
    rows = running(ks.withColumn("bucket", -F.floor(F.col("k") / F.col("width"))), ["graph_id"], "bucket", [F.desc("k")], "gain")
    return rows.join(F.broadcast(counts), "graph_id").select("graph_id", "k", F.col("upto").alias("pairs"), F.when(F.col("n") > 1, F.col("upto") / (F.col("n") * (F.col("n") - 1) / 2)).alias("conn"))
