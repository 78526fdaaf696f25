"""The classifier's fit against its objective, written out as loops."""

import math
import random

import numpy as np
import pyarrow as pa

from tessella.llm.toxicity import Fit, descended


def sample(n=60, m=8, seed=5):
    """Rows (features, toxic, swaps): features 0 and 1 go with toxic rows, 7 is an identity term that does so too and is swapped for 6."""
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        toxic = draw.random() < 0.4
        found = [j for j in range(m) if draw.random() < (0.7 if toxic and j in (0, 1, 7) else 0.25)]
        swaps = [[7, -1, 6]] if 7 in found else [[6, -1, 7]] if 6 in found and draw.random() < 0.5 else []
        rows.append((found, int(toxic), swaps))
    return rows


def objective(weights, bias, rows, occurs, fit):
    """Loss with toxic rows counted twice, the ridge and the mean squared change of the score under swaps."""
    loss = 0.0
    for found, toxic, _ in rows:
        z = bias + sum(weights[j] for j in found)
        loss += (2 if toxic else 1) * (math.log1p(math.exp(-z)) if toxic else math.log1p(math.exp(z))) / len(rows)
    ridge = sum(fit.ridge * w * w * (0.05 + 1 / math.sqrt(k)) / 2 for w, k in zip(weights, occurs))
    changes = [sum(weights[x] for x in s[: s.index(-1)]) - sum(weights[x] for x in s[s.index(-1) + 1 :]) for *_, swaps in rows for s in swaps]
    return loss + ridge + fit.fairness * sum(c * c for c in changes) / max(1, len(changes)) / 8


def fitted(rows, fit, m=8):
    table = pa.table({"features": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "toxic": pa.array([r[1] for r in rows], pa.int32()), "swaps": pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int64())))})
    occurs = np.array([sum(j in r[0] for r in rows) for j in range(m)])
    model = descended(table, np.arange(m), occurs, fit)
    return [model.weights.get(j, 0.0) for j in range(m)], model.bias, occurs, model.pairs


def test_fit_is_the_least_of_its_objective():
    rows = sample()
    for fairness in (0.0, 1.0, 20.0):
        fit = Fit(ridge=0.02, fairness=fairness, rounds=20_000)
        weights, bias, occurs, pairs = fitted(rows, fit)
        assert pairs == sum(len(r[2]) for r in rows)
        least, draw = objective(weights, bias, rows, occurs, fit), random.Random(1)
        for step in (1e-2, 1e-1, 1.0):
            for _ in range(100):
                moved = [w + draw.gauss(0, step) for w in weights]
                assert objective(moved, bias + draw.gauss(0, step), rows, occurs, fit) >= least - 1e-9


def test_penalty_draws_swapped_terms_together():
    rows = sample()
    apart = [abs(w[7] - w[6]) for w, *_ in (fitted(rows, Fit(fairness=f, rounds=5_000)) for f in (0.0, 1.0, 20.0))]
    assert apart[0] > 2 * apart[1] > 2 * apart[2] and apart[2] < 0.2


def test_registered_rounds_come_near_the_least():
    rows = sample()
    fit = Fit()
    weights, bias, occurs, _ = fitted(rows, fit)
    best, best_bias, *_ = fitted(rows, Fit(rounds=20_000))
    assert objective(weights, bias, rows, occurs, fit) <= objective(best, best_bias, rows, occurs, fit) + 1e-3
