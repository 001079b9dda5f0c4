"""The extendible-hash index against grouping by text."""

import collections
import hashlib
import random

import pytest

from unravel.llm import exact_index
from unravel.llm.common import staged

ROWS = "doc_id long, text string, keep_id string, key long"


def expected(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    out = []
    for i, t in rows:
        same = groups[(t or "").encode().lower()]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode().lower()).hexdigest()))
    return sorted(out, key=repr)


def some_rows():
    rng = random.Random(1)
    texts = ["", None, "a", "A", "Straße", "STRASSE", "É", "é", "x" * 200_000, "X" * 200_000, "日本\n語", " a"] + [f"t{i}" for i in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, "Hot copy" if i % 2 else "HOT copy") for i in range(300)]
    return rows + [(None, "alone"), (None, "hot COPY"), (7, "twice"), (7, "twice"), (5, "unlike row of 5")]


@pytest.mark.parametrize("capacity,key_bits", [(4096, 60), (2, 60), (2, 4), (1, 1)])
def test_groups(spark, capacity, key_bits):
    """Few key bits put many texts on one chain; a small capacity splits often."""
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], ROWS).repartition(5)
    got = exact_index.exact_groups(docs, capacity, key_bits).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_directory(spark):
    """Slots cover all prefixes once; no bucket but one of full depth is overfull, and
    the parent of each is."""
    keys = staged(spark.range(500).selectExpr("shiftrightunsigned(xxhash64(id), 52) AS key").distinct(), "testkeys")
    found = [r.key for r in keys.collect()]
    buckets = exact_index.directory(keys, len(found), 5, 12)
    rows = buckets.collect()
    deepest = max(r.depth for r in rows)
    assert sorted(r.slot for r in exact_index.slots(buckets, deepest, 12).collect()) == list(range(1 << deepest))
    inside = lambda first, depth: sum(k >> 12 - depth == first >> 12 - depth for k in found)
    for r in rows:
        assert r.n == inside(r.bucket, r.depth) and (r.n <= 5 or r.depth == 12)
        assert r.depth == 0 or inside(r.bucket, r.depth - 1) > 5


def test_lookup_and_files(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = staged(exact_index.hashed(docs, 60), "testhashes")
    index = exact_index.build(docs, hashes, capacity=4)
    want = {(t or "").lower(): (k, n) for (i, t), (_, k, n, _, _) in ((r, e) for r in rows for e in expected(rows) if e[4] == hashlib.sha256((r[1] or "").encode().lower()).hexdigest())}
    asked = spark.createDataFrame([(1, "HOT COPY"), (2, "never seen"), (3, "T5"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in index.lookup(asked).collect()}
    assert got == {1: want["hot copy"], 2: (None, None), 3: want["t5"], 4: want[""]}
    assert index.entries.groupBy("bucket", "key", "chain").count().where("count > 1").count() == 0


def test_drop_and_empty(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], ROWS)
    left = exact_index.drop_exact_copies(docs)
    assert left.columns == docs.columns
    want = sorted(((i, (t or "").lower()) for (i, t) in rows if i == max((x for x, u in rows if (u or "").encode().lower() == (t or "").encode().lower() and x is not None), default=None)), key=repr)
    assert sorted(((r.doc_id, (r.text or "").lower()) for r in left.collect()), key=repr) == want
    assert exact_index.exact_groups(docs.limit(0)).count() == 0
