"""Streams with state of their own: a replay ring, and episodes that may stay open.

Both use ``transformWithState``, which keeps its state in RocksDB (``rocksdb`` sets that).
A key's rows of a micro-batch are put in order of seq; keys are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _rows(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    out: list[tuple] = []
    for b in batches:
        out += zip(*(b[c].tolist() for c in columns), strict=True)
    return sorted(out, key=lambda r: r[:1])  # stable: equal seqs stay in order of arrival


#: Slots of a ring that are one entry of its state.
PAGE = 256


class Ring(StatefulProcessor):
    """State: a map from page (of PAGE slots) to the seqs of its slots so far, and one value,
    the number of rows so far with the least and greatest priority of all of them. A key's
    micro-batch reads and writes a page once, whatever number of rows it has there."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "n long, least double, most double")
        self.pages = handle.getMapState("pages", "page long", "seqs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, least, most = self.head.get() if self.head.exists() else (0, None, None)
        out, pages = [], {}
        for seq, priority in _rows(rows, "seq", "priority"):
            slot = n % self.capacity
            page, place = divmod(slot, PAGE)
            if page not in pages:
                pages[page] = list(self.pages.getValue((page,))[0]) if n > page * PAGE else []
            held = pages[page]
            if place < len(held):
                gone, held[place] = held[place], seq
            else:
                gone = None
                held.append(seq)
            least, most = (priority, priority) if least is None else (min(least, priority), max(most, priority))
            n += 1
            out.append((key[0], seq, slot, priority, gone, least, most))
        for page, held in pages.items():
            self.pages.updateValue((page,), (held,))
        self.head.update((n, least, most))
        found = pd.DataFrame(out, columns=["memory", "seq", "slot", "priority", "gone", "least", "most"])
        yield found.astype({"gone": "Int64"})

    def close(self) -> None:
        pass


def stream_ring(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows``: streaming (memory, seq, priority), seqs rising from one micro-batch to the
    next. Each row enters the next slot of its memory's ring: memory, seq, slot, priority,
    gone (the seq that it overwrites, or null), least and most (priorities over all
    history, overwritten rows included). The state holds ``capacity`` slots a memory."""
    schema = "memory long, seq long, slot long, priority double, gone long, least double, most double"
    return rows.groupBy("memory").transformWithStateInPandas(Ring(capacity), schema, "append", "none")


class Episodes(StatefulProcessor):
    """State: the rows held back, the greatest seq that left, and the timer's time."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seqs array<long>, actions array<long>, rewards array<double>, left long, due long")

    def _given(self, episode: int, held: list[tuple], done: int, late: list[tuple]) -> pd.DataFrame:
        out = [(episode, s, a, r, None, None, False, True) for s, a, r in late]
        for i, (s, a, r) in enumerate(held[:done]):
            after = held[i + self.n][1] if i + self.n < len(held) else None
            out.append((episode, s, a, r, sum(x[2] for x in held[i : i + self.n]), after, after is None, False))
        names = ["episode", "seq", "action", "reward", "nstep_return", "next_action", "terminal", "late"]
        return pd.DataFrame(out, columns=names).astype({"next_action": "Int64", "nstep_return": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, left, due = [], None, None
        if self.held.exists():
            seqs, actions, rewards, left, due = self.held.get()
            held = list(zip(seqs, actions, rewards, strict=True))
        new = _rows(rows, "seq", "action", "reward", "last", "at_ms")
        late = [r[:3] for r in new if left is not None and r[0] <= left]
        held = sorted(held + [r[:3] for r in new if left is None or r[0] > left], key=lambda r: r[0])
        ended = any(r[3] for r in new)
        done = len(held) if ended else max(len(held) - self.n, 0)
        if due is not None:
            self.handle.deleteTimer(due)
        if ended:
            self.held.clear()
        else:
            due = max([r[4] for r in new] + ([due - self.idle_ms] if due is not None else [])) + self.idle_ms
            self.handle.registerTimer(due)
            left = held[done - 1][0] if done else left
            self.held.update((*(list(x) for x in (zip(*held[done:], strict=True) if held[done:] else ([], [], []))), left, due))
        yield self._given(key[0], held, done, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        seqs, actions, rewards, _, _ = self.held.get()
        held = list(zip(seqs, actions, rewards, strict=True))
        self.held.clear()
        yield self._given(key[0], held, len(held), [])

    def close(self) -> None:
        pass


def stream_episodes(events: DataFrame, n: int, idle_ms: int = 600_000, delay: str = "1 minute") -> DataFrame:
    """``events``: streaming (episode, seq, action, reward, at, last). episode, seq,
    action, reward, nstep_return, next_action, terminal, late.

    A transition leaves once the n rewards from it are known. An episode ends with the
    event marked ``last``, or once the watermark (``delay`` behind the latest event of
    all) is ``idle_ms`` past its own latest event: what is held back then leaves as
    terminal, so an episode that is never marked holds n events for a bounded time.
    Events out of order are put in place among those held back. One whose seq is not
    over that of a transition that left comes too late for it: it leaves at once with a
    null return, marked ``late``. What comes after the end begins an episode anew."""
    schema = "episode long, seq long, action long, reward double, nstep_return double, next_action long, terminal boolean, late boolean"
    timed = events.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("episode").transformWithStateInPandas(Episodes(n, idle_ms), schema, "append", "EventTime")
