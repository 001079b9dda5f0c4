"""The greedy influence order from shares against that of the whole graph."""

import random

import pytest

from unravel.operators import cascade


@pytest.mark.parametrize("most", [None, 9])
def test_shares(spark, most):
    rng = random.Random(5)
    rows, parts, size = [], {}, {}
    for g in range(2):
        for sim in range(3):
            for block in range(12):  # no simulation joins two blocks
                ids = list(range(block, 120, 12))
                for v in ids:
                    comp = min(ids[: rng.randrange(1, 9)]) if rng.random() < 0.5 else v
                    rows.append((g, sim, v, comp))
    for g, sim, v, comp in rows:
        parts.setdefault(g, {}).setdefault(v, []).append((sim, comp))
        size.setdefault(g, {}).setdefault((sim, comp), 0)
        size[g][sim, comp] += 1
    want = {(g, k, v, gain) for g in parts for k, (v, gain) in enumerate(cascade.lazy_greedy(parts[g], size[g], most))}
    labels = spark.createDataFrame(rows, "graph_id long, sim long, id long, comp long")
    got = cascade.influence_order(labels, most, share_rows=40).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
