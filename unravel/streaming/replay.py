"""Streaming ingestion of episodes: transitions leave when their n steps are known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

OUT = "episode long, seq long, action long, reward double, nstep_return double, next_action long, terminal boolean"
STATE = "seqs array<long>, actions array<long>, rewards array<double>"


def stream_nstep(events: DataFrame, n: int) -> DataFrame:
    """``events``: streaming (episode, seq, action, reward, and last where given), in
    order of seq from one micro-batch to the next. A transition is emitted once the n
    rewards from it are known; the event marked ``last`` ends its episode, and the
    transitions held back leave with the rewards there are, a null next_action and
    terminal. So an episode of T events gives T transitions. The state holds at most
    n events an episode and goes at its end."""
    if "last" not in events.columns:
        events = events.withColumn("last", F.lit(False))

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        ended = False
        for b in batches:  # a micro-batch of one episode
            held += zip(b.seq.tolist(), b.action.tolist(), b.reward.tolist(), strict=True)
            ended = ended or bool(b["last"].any())
        held.sort()
        done = len(held) if ended else max(len(held) - n, 0)
        out = {"episode": [key[0]] * done, "seq": [x[0] for x in held[:done]], "action": [x[1] for x in held[:done]], "reward": [x[2] for x in held[:done]]}
        out["nstep_return"] = [sum(x[2] for x in held[i : i + n]) for i in range(done)]
        out["next_action"] = pd.array([held[i + n][1] if i + n < len(held) else None for i in range(done)], dtype="Int64")
        out["terminal"] = [i + n >= len(held) for i in range(done)]
        if ended:
            state.remove()
        else:
            state.update(tuple(map(list, zip(*held[done:], strict=True))) if held[done:] else ([], [], []))
        yield pd.DataFrame(out)

    return events.groupBy("episode").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")
