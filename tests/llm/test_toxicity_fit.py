"""The fit of toxicity where texts have most of their features in common."""

import numpy as np

from unravel.llm.toxicity import newton


def test_fit_does_not_run_away():
    rng, rows = np.random.default_rng(3), []
    for i in range(2000):
        toxic = int(i % 10 == 0)
        line = np.arange(40) if rng.random() < 0.97 else np.empty(0, dtype=np.int64)
        own = 41 + rng.choice(200, 12, replace=False)
        rows.append((np.concatenate([line, [40] if toxic else [], own]).astype(np.int64), None, toxic))
    bias, w = newton(rows, 241)
    scores = np.array([bias + w[x].sum() for x, _, _ in rows])
    y = np.array([t for _, _, t in rows])
    assert np.abs(scores).max() < 30
    assert scores[y == 1].min() > scores[y == 0].max()
