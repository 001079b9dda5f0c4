"""Replay memory: n-step transitions, rings, and prioritised sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import draw


def _order() -> Window:
    return Window.partitionBy("episode").orderBy("step")


def nstep(steps: DataFrame, n: int) -> DataFrame:
    """``steps``: episode, step from 0, action, reward. Adds suffix_sum, nstep_return
    (of at most n rewards), next_action (n steps on; null past the end), terminal and
    state_len (actions before). The return is a difference of suffix sums, whatever
    n is."""
    w = _order()
    suffix = F.sum("reward").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = steps.withColumn("suffix_sum", suffix)
    total = F.count(F.lit(1)).over(Window.partitionBy("episode"))
    return s.select("episode", "step", "action", "reward", "suffix_sum", (F.col("suffix_sum") - F.coalesce(F.lead("suffix_sum", n).over(w), F.lit(0.0))).alias("nstep_return"), F.lead("action", n).over(w).alias("next_action"), (F.col("step") + n >= total).alias("terminal"), F.col("step").alias("state_len"))


def state_prefix(steps: DataFrame) -> DataFrame:
    """episode, step, state: the actions before, in order."""
    held = F.collect_list("action").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return steps.select("episode", "step", held.alias("state"))


def successor_state(steps: DataFrame, n: int) -> DataFrame:
    """episode, step, next_state: the actions before the state n steps on, or all of the
    episode's if it ends before that."""
    whole = steps.groupBy("episode").agg(F.sort_array(F.collect_list(F.struct("step", "action"))).alias("all"))
    # An episode's actions are one row already: its states are.
    one = whole.select("episode", F.col("all.action").alias("actions"), F.explode("all.step").alias("step"))
    return one.select("episode", "step", F.slice("actions", 1, F.least(F.col("step") + n, F.size("actions")).cast("int")).alias("next_state"))


def ring(rows: DataFrame, capacity: int, seq: str = "seq") -> DataFrame:
    """The last ``capacity`` rows by ``seq`` (dense from 0), with their slot."""
    last = rows.agg(F.max(seq).alias("__last"))
    kept = rows.join(F.broadcast(last)).where(F.col(seq) > F.col("__last") - capacity).drop("__last")
    return kept.withColumn("slot", (F.col(seq) % capacity).cast("long"))


def priority(error: Column, epsilon: float = 0.01, upper: float = 1.0, alpha: float = 0.6) -> Column:
    """min(error + epsilon, upper) ** alpha."""
    return F.pow(F.least(error + epsilon, F.lit(upper)), F.lit(alpha))


def start_priority(priorities: DataFrame, upper: float = 1.0) -> DataFrame:
    """One row: the priority of a new transition, the most so far or ``upper``."""
    return priorities.agg(F.coalesce(F.max("priority"), F.lit(upper)).alias("priority"))


def history(priorities: DataFrame, upper: float = 1.0) -> DataFrame:
    """One row: least and most of all priorities that were ever set, and start, that of a
    new transition; a memory never unlearns them."""
    return priorities.agg(F.min("priority").alias("least"), F.max("priority").alias("most"), F.coalesce(F.max("priority"), F.lit(upper)).alias("start"))


def leaf_order(slot: Column, capacity: int) -> Column:
    """The place of a slot among a heap's leaves from left to right: leaves of the
    deepest level come first."""
    deep = 2 * (capacity - (1 << (capacity.bit_length() - 1))) if capacity & (capacity - 1) else capacity
    return F.when(slot >= capacity - deep, slot - (capacity - deep)).otherwise(slot + deep)


def cumulative(slots: DataFrame, capacity: int) -> DataFrame:
    """slot, priority, lo, hi: the range of each slot in leaf order."""
    place = leaf_order(F.col("slot"), capacity)
    hi = F.sum("priority").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return slots.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("priority"))


def stratified(slots: DataFrame, capacity: int, n: int, offset: float = 0.5, beta: float = 0.4) -> DataFrame:
    """draw, slot, priority, weight: one draw in each of n equal segments, at
    ``offset`` of it, and importance weights (p / least p) ** -beta. A memory has
    ``capacity`` slots at most, which bounds the one-task prefix sum."""
    c = cumulative(slots, capacity)
    stats = slots.agg(F.sum("priority").alias("total"), F.min("priority").alias("least"))
    draws = slots.sparkSession.range(n).select(F.col("id").alias("draw")).join(F.broadcast(stats))
    draws = draws.withColumn("v", (F.col("draw") + offset) * F.col("total") / n)
    hit = F.broadcast(draws).join(c, (F.col("lo") < F.col("v")) & (F.col("v") <= F.col("hi")))
    return hit.select("draw", "slot", "priority", F.pow(F.col("priority") / F.col("least"), F.lit(-beta)).alias("weight"))


def uniform(slots: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """draw, slot: n draws with replacement, by ``functions.draw`` of (seed, draw)."""
    size = slots.agg(F.count(F.lit(1)).alias("size"))
    ranked = slots.select("slot", (F.row_number().over(Window.orderBy("slot")) - 1).alias("r"))
    draws = slots.sparkSession.range(n).join(F.broadcast(size)).select(F.col("id").alias("draw"), F.pmod(draw(seed, F.col("id")), F.col("size")).alias("r"))
    return draws.join(ranked, "r").select("draw", "slot")
