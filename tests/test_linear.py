import random

import numpy as np
import pytest

from riskloom.plans.linear import Linear, Penalty, fit, robust_scales

FEATURES = ["a", "b", "c", "d"]


def table(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(4, 3), rng.choice([None, 0.0, 1.0])
        rows.append((i, int(a - 0.4 * (b - 4) + rng.gauss(0, 1) > 0.5), i % 4, i * 7 % 3, a, b, c, 5.0))
    return rows, spark.createDataFrame(rows, "row_id bigint, y int, fold int, other int, a double, b double, c double, d double").repartition(4)


def slow(x, y, p):
    """Many small proximal steps."""
    w = np.zeros(x.shape[1] + 1)
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    rate = 1 / (0.25 * np.linalg.eigvalsh(z.T @ z).max() + p.strength)
    momentum, t = w.copy(), 1.0
    for _ in range(20000):
        g = z.T @ (1 / (1 + np.exp(-z @ momentum)) - y)
        g[1:] += p.strength * (1 - p.lasso) * momentum[1:]
        new = momentum - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * p.strength * p.lasso, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, t, w = new + (t - 1) / t_next * (new - w), t_next, new
    return w


@pytest.mark.parametrize("p", [Penalty(), Penalty(strength=30.0, lasso=1.0), Penalty(strength=0.01, lasso=0.0)])
def test_equal_to_many_small_steps(spark, p):
    data, df = table(spark, 200)
    middle, spread = robust_scales(df, FEATURES)
    x = np.array([[m if v is None else v for v, m in zip(r[4:], middle)] for r in data])
    assert middle.tolist() == pytest.approx([np.median([r[4 + j] for r in data if r[4 + j] is not None]) for j in range(4)])
    x, y, fold, other = (x - middle) / spread, np.array([r[1] for r in data]), np.array([r[2] for r in data]), np.array([r[3] for r in data])
    held = [None, ("fold", 2), ("other", 0)]
    models, scores = fit(df, FEATURES, p, held)
    for m, seen in zip(models, (np.ones(200, bool), fold != 2, other != 0)):
        assert m.done and m.w == pytest.approx(slow(x[seen], y[seen], p), abs=1e-5)
    got = {(r["model"], r["row_id"]): r["p"] for r in scores.collect()}
    assert len(got) == 200 + (fold == 2).sum() + (other == 0).sum()
    want = 1 / (1 + np.exp(-(x @ models[1].coefficients + models[1].intercept)))
    assert all(got[1, i] == pytest.approx(want[i]) for i in np.flatnonzero(fold == 2))


def test_separable_one_class_balanced_and_no_rows(spark):
    df = spark.createDataFrame([(i, int(i >= 20), float(i), None) for i in range(25)], "row_id bigint, y int, a double, b double")
    models, scores = fit(df, ["a", "b"], Penalty(strength=1e-4))
    assert models[0].done and models[0].coefficients[1] == 0 and all((r["p"] > 0.5) == (r["y"] == 1) for r in scores.collect())
    plain, balanced = (fit(df, ["a", "b"], Penalty(strength=100.0, balanced=b))[0][0] for b in (False, True))
    assert balanced.intercept > plain.intercept
    models, scores = fit(df.limit(0), ["a", "b"])
    assert scores.collect() == [] and isinstance(models[0], Linear) and not models[0].w.any()
