"""Passages of items with edits, against alignment of all pairs."""

import random

import numpy as np
import pytest

from unravel.llm import decontaminate as dc


def every(words, k, edit):
    return [y for i, w in enumerate(words) for y in (edit(w, i) if i % k == k - 1 else [w])]


@pytest.mark.parametrize("vocab", [5000, 60])
def test_edited_copies_by_brute_force(vocab):
    rng = random.Random(vocab)
    new = lambda: f"n{rng.randrange(10**6)}"
    items = [(k, [f"w{rng.randrange(vocab)}" for _ in range(n)]) for k, n in enumerate([3, 4, 5, 6, 7, 9, 16, 16, 25, 40, 40, 59, 59])]
    texts = []
    for _, w in items:
        copies = [w, *(every(w, k, lambda x, i: [new()]) for k in (2, 3, 4, 5, 6)), *(every(w, k, lambda x, i: [x, new()]) for k in (1, 2, 3)), *(every(w, k, lambda x, i: []) for k in (3, 4, 5))]
        copies += [[new() if rng.random() < p else x for x in w] for p in (0.1, 0.2, 0.25)]
        texts += [[f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(60))] + c + [new()] * 3 + [f"w{rng.randrange(vocab)}" for _ in range(40)] for c in copies]
    index = dc.Index([(k, " ".join(w).encode()) for k, w in items], 0.6)
    found, pairs = 0, 0
    often = np.zeros(len(index.codes), dtype=np.int64)
    for t in texts:
        often[np.unique(index.hits(index.ids([x.encode() for x in t]))[1])] += 1
    rare = index.rare(often)
    assert 0 < rare.sum() < len(rare)  # the most frequent pairs are no seeds
    for t in texts:
        ids = index.ids([x.encode() for x in t])
        got = {k: score for k, score, _, _ in dc.matches(index, ids, 0.6, rare)}
        want = {k: s for k, w in enumerate(index.words) if (s := dc.align(w, ids)[0] / (2 * len(w))) >= 0.6 - 1e-12}
        assert got == pytest.approx(want)
        found, pairs = found + len(got), pairs + len(want)
    assert found == pairs > 80


def test_a_lone_edited_copy(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(500)}" for _ in range(40)]
    rows = [(0, " ".join(every(item, 5, lambda w, i: [f"edit{i}"])))] + [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(80))) for k in range(1, 30)]
    whole = [(99, " ".join(item))]
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for docs in (rows, rows + whole):
        got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
        assert {r.doc_id for r in got} == {d for d, _ in docs if d in (0, 99)}
