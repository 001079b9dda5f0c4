"""Stateful streams over several micro-batches, and against batch windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from unravel.streaming import stateful

EVENTS = "episode long, seq long, action long, reward double, at timestamp, last boolean"


@pytest.fixture()
def run(spark, tmp_path):
    """Rows of a stream whose files come one a micro-batch."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.rocksdb(spark)

    def go(batches, schema, make):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    yield go
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_ring_equals_windows(spark, run):
    rng = random.Random(1)
    rows = [(rng.choice((1, 1, 1, 2, 3)), k, round(rng.random(), 3)) for k in range(200)]
    schema = "memory long, seq long, priority double"
    got = run([rows[:70], rows[70:71], rows[71:]], schema, lambda s: stateful.stream_ring(s, 7)).collect()
    w = Window.partitionBy("memory").orderBy("seq")
    n = F.row_number().over(w) - 1
    want = spark.createDataFrame(rows, schema).select("memory", "seq", (n % 7).cast("long").alias("slot"), "priority", F.lag("seq", 7).over(w).alias("gone"), F.min("priority").over(w).alias("least"), F.max("priority").over(w).alias("most"))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want.collect()), key=str)


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_open_late_and_unmarked_episodes(run):
    batches = [
        [(1, 0, 10, 1.0, at(0), False), (1, 2, 12, 4.0, at(1), False), (2, 0, 20, 1.0, at(0), False), (2, 1, 21, 1.0, at(0), True)],
        [(1, 1, 11, 2.0, at(1), False), (1, 3, 13, 8.0, at(2), False)],  # seq 1 in place among those held back
        [(1, 0, 99, 5.0, at(2), False)],  # seq 0 has left
        [(3, 7, 30, 1.0, at(60), False)],  # the watermark goes past episode 1
        [(3, 8, 31, 1.0, at(60), True)],
    ]
    rows = run(batches, EVENTS, lambda s: stateful.stream_episodes(s, 2, 600_000, "1 minute")).collect()
    got = sorted(((r.episode, r.seq, r.action, r.nstep_return, r.next_action, r.terminal, r.late) for r in rows), key=lambda r: r[:3])
    assert got == [
        (1, 0, 10, 3.0, 12, False, False),
        (1, 0, 99, None, None, False, True),
        (1, 1, 11, 6.0, 13, False, False),
        (1, 2, 12, 12.0, None, True, False),
        (1, 3, 13, 8.0, None, True, False),
        (2, 0, 20, 2.0, None, True, False),
        (2, 1, 21, 1.0, None, True, False),
        (3, 7, 30, 2.0, None, True, False),
        (3, 8, 31, 1.0, None, True, False),
    ]


class Kept:
    """A state of one value or a map that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return None in self.held

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value


def test_ring_asks_its_state_by_pages_and_not_by_rows():
    class Handle:
        states = []

        def getValueState(self, *_):
            self.states.append(Kept())
            return self.states[-1]

        getMapState = getValueState

    import pandas as pd

    for capacity in (1, 8, 255, 256, 257, 700):
        ring = stateful.Ring(capacity)
        ring.init(Handle())
        kept, start, got = Handle.states[-1], 0, []
        for size in (1, 300, 5, 1200, 90):
            rows = pd.DataFrame({"seq": range(start, start + size), "priority": [0.5] * size})
            got += [g for f in ring.handleInputRows((1,), iter([rows]), None) for g in f.itertuples(index=False)]
            start += size
        assert [(r.slot, None if r.gone is pd.NA else r.gone) for r in got] == [(i % capacity, i - capacity if i >= capacity else None) for i in range(start)]
        assert kept.calls <= 5 * 2 * (capacity // 256 + 1)
