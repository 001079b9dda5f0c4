"""Groups of similar rows from shared keys, without all pairs of a key.

Rows that share a key are candidates. In each key the most central node, the one whose
keys have most nodes, is the hub and the others are checked against it; confirmed links
give components. A hub then leaves its key: it has been checked against all others
there. A key is done once its other nodes lie in one component, since a pair within
a component can't change it. Rounds go on while they link enough.

Nodes of keys that are still open get finer keys (``refine``), which tell unlike nodes
apart, and the same rounds; pairs that still share an open key and are in different
components are joined under ``may``, a bound that no pair to be confirmed fails, and
checked too. No candidate is dropped; pairs that fail the bound are never made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..operators.components import settled
from .common import gathered, near, release, staged

#: Rounds of hubs for a set of keys, and the share of a round's pairs that must hold for
#: another round to be worth while.
HUB_ROUNDS, HUB_GAIN = 4, 0.05


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of nodes with links (a, b)."""
    rows = 2 * (links.staged_rows if hasattr(links, "staged_rows") else links.count())
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    arcs = links.select(F.explode(ends).alias("e")).select("e.*")
    first = staged(gathered(arcs.select(F.col("src").alias("id")).distinct(), rows).select("id", F.col("id").alias("comp")), "labels")
    few = lambda df: near(df, rows)
    out = settled(first, arcs, (), lambda df: staged(gathered(df, rows), "labels"), release, few)
    out = out.select(F.col("id").alias("node"), F.col("comp").alias("component"))
    out.staged_rows = rows
    return out


def grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """``components`` of all links so far from those without ``links`` and the new
    ``links``: only the merges of components are searched."""
    if groups is None:
        return components(links)
    if not links.staged_rows:
        return groups
    at = lambda s: near(hub_groups(groups, s, f"c{s}"), groups.staged_rows)
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merges = staged(gathered(ends.where("a <> b").distinct(), links.staged_rows), "merges")
    fresh_nodes = gathered(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * links.staged_rows).join(near(groups.select("node"), groups.staged_rows), "node", "left_anti")
    out = groups.select("node", "component").union(fresh_nodes.select("node", F.col("node").alias("component")))
    if merges.staged_rows:
        up = components(merges)
        out = out.join(near(hub_groups(up, "component", "least"), up.staged_rows), "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return staged(out, "groups")


def shared_rows(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, node, x) whose key several nodes have, with size (their
    number) and rank: the nodes that its node meets in all its keys. Staged."""
    counts = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    rows = staged(keys.join(near(counts), "key"), "keys")
    rank = rows.groupBy("node").agg(F.sum("n").alias("rank"))
    out = staged(gathered(rows.withColumnRenamed("n", "size").join(near(rank, rows.staged_rows), "node"), rows.staged_rows), "ranked")
    release(rows)
    return out


def linked(keys: DataFrame, confirm: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame], may: Callable[[Column, Column], Column], first_may: Callable[[Column, Column], Column] | None = None, first_pairs: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, open_pairs: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, links) from rows (key, node, x), distinct by key and node.

    ``confirm`` takes distinct pairs (a < b) and returns those that hold; ``refine``
    gives such rows of the nodes (node) of open keys; ``may`` is the bound on the
    structs x of two rows of a refined key, ``first_may`` that of the first keys.
    ``first_pairs`` takes the first keys' rows and gives the pairs (a, b) of the keys that
    need no hub, which are checked at once, and the rows of the others; both staged.
    ``open_pairs`` does so with the rows (and component) that are open after the first hubs.
    Both leave out links within a component that other links give.
    """
    links = tested = groups = None
    for level in range(2):
        bound = may if level else first_may
        if first_pairs and not level:
            pairs, keys = first_pairs(keys)
            tested = fresh(pairs, None, pairs.staged_rows)
            links, groups = in_turns(confirm, tested, None)
            if not keys.staged_rows:
                break
        rows = shared_rows(keys)
        if not rows.staged_rows:
            break
        for turn in range(HUB_ROUNDS if level else 1):
            if groups is not None:
                rows = opened(rows, groups)
                if not rows.staged_rows:
                    break
            order = F.struct("rank", "node") if turn % 2 == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            hubs = gathered(rows.groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("h"), F.col("x").alias("hx")), order).alias("hub")), rows.staged_rows).select("key", "hub.*")
            hubs = staged(hubs, "hubs")
            on = rows.join(near(hubs), "key").where("node <> h")
            unlike = on if groups is None else on.join(near(hub_groups(groups, "h", "hc"), groups.staged_rows), "h", "left").where("component <> coalesce(hc, h)")
            pairs = unlike.where(bound(F.col("x"), F.col("hx"))) if bound else unlike
            new = fresh(pairs.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")), tested, rows.staged_rows)
            found = checked(confirm, new)
            tested, links = merged(tested, new), merged(links, found)
            left = staged(gathered(on.select(*rows.columns), rows.staged_rows), "left")
            release(rows)
            rows = left
            groups = grown(groups, found)
            if found.staged_rows <= HUB_GAIN * new.staged_rows:
                break
        rows = opened(rows, groups)
        if not rows.staged_rows:
            break
        if level:
            left = rows.select("key", F.col("node").alias("l"), F.col("component").alias("lc"), F.col("x").alias("lx"))
            right = rows.select("key", F.col("node").alias("r"), F.col("component").alias("rc"), F.col("x").alias("rx"), "main")
            # Pairs of two components beside the main one are made once, from the lesser.
            once = F.expr("lc <> rc") & (F.expr("rc = main") | F.expr("l < r"))
            pairs = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("lc") != F.col("main")) & once & may(F.col("lx"), F.col("rx")))
            new = fresh(pairs.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")), tested, rows.staged_rows)
            found = checked(confirm, new)
            links, groups = merged(links, found), grown(groups, found)
        else:
            if open_pairs:
                pairs, rows = open_pairs(rows)
                new = fresh(pairs, tested, pairs.staged_rows)
                found, groups = in_turns(confirm, new, groups)
                tested, links = merged(tested, new), merged(links, found)
                if not rows.staged_rows:
                    break
            keys = refine(rows)
    if links is None:
        kind = keys.schema["node"].dataType
        links = staged(keys.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links")
        groups = links.select(F.col("a").cast(kind).alias("node"), F.col("b").alias("component"))
        groups.staged_rows = 0
    return groups, links


def hub_groups(groups: DataFrame, node: str, component: str) -> DataFrame:
    return groups.select(F.col("node").alias(node), F.col("component").alias(component))


def opened(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of keys whose nodes lie in several components, with component and main,
    the key's component of most nodes. Releases ``rows``."""
    keep = [c for c in rows.columns if c not in ("component", "main")]
    at = rows.select(*keep).join(near(groups, groups.staged_rows), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = at.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("most.component").alias("main"))
    several = staged(gathered(several, rows.staged_rows), "open")
    out = staged(gathered(at.join(near(several), "key").select(*keep, "component", "main"), rows.staged_rows), "left")
    release(rows)
    return out


def fresh(pairs: DataFrame, tested: DataFrame | None, rows: int) -> DataFrame:
    """Distinct pairs that aren't in ``tested``; staged."""
    pairs = gathered(pairs.distinct(), rows)
    return staged(pairs if tested is None else pairs.join(near(tested), ["a", "b"], "left_anti"), "pairs")


def checked(confirm: Callable[[DataFrame], DataFrame], pairs: DataFrame) -> DataFrame:
    return staged(confirm(pairs), "links")  # not gathered: a pair may hold two long texts


def in_turns(confirm: Callable[[DataFrame], DataFrame], pairs: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the staged ``pairs``: each node's pair with its least partner is
    checked first, then those that still lie in two components. The others can't
    change the components."""
    one = staged(gathered(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), pairs.staged_rows), "firstpairs")
    links = checked(confirm, one)
    groups = grown(groups, links)
    at = lambda s: near(hub_groups(groups, s, f"c{s}"), groups.staged_rows)
    left = pairs.join(near(one.select(F.col("a").alias("least"), "b")), "b").where("a <> least").select("a", "b")
    apart = left.join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    rest = staged(gathered(apart, pairs.staged_rows), "apart")
    release(one)
    if rest.staged_rows:
        found = checked(confirm, rest)
        links, groups = merged(links, found), grown(groups, found)
    return links, groups


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is None:
        return new
    out = old.union(new)
    out.staged_rows = old.staged_rows + new.staged_rows
    return out
