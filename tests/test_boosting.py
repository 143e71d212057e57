import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans import boosting, models
from riskloom.plans.boosting import MISSING, Parameters, binned, cross_validated, curves, drawn, fit, importance, predict, scorer_of, split_gains

FEATURES = ["a", "b", "c"]


def rows(n, seed=1, missing=0.1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.randrange(5), rng.choice([0.5, 2.0, None, float("nan")])
        y = int(a + 0.5 * b + rng.gauss(0, 0.7) > 1.5)
        out.append((i, y, i * 7 % 5, None if rng.random() < missing else a, float(b), c))
    return out


def table(spark, data):
    return spark.createDataFrame(data, "row_id bigint, y int, fold int, a double, b double, c double").repartition(5)


def plain_boosting(x, y, w, seen, p, edges, rising, base):
    """Raw scores after each tree of one model, every split tried by masks; x: bins."""
    scale = 1 << boosting.SHIFT
    raw, out = np.full(len(y), base), []
    bins = p.bins + 1
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = np.rint(w * (prob - y) * scale).astype(np.int64), np.rint(w * prob * (1 - prob) * scale).astype(np.int64)
        value = np.zeros(len(y))

        def leaf(gs, hs, low, high):
            s = np.sign(gs) * max(abs(gs) - p.lasso, 0)
            return min(max(-s / max(hs + p.ridge, 1e-12), low), high)

        def worth(gs, hs, v):
            return -(gs * v + 0.5 * (hs + p.ridge) * v * v + p.lasso * abs(v))

        def grow(rows, depth, low, high, own):
            best, use = None, seen & rows & (w > 0)
            if depth < p.depth:
                gt, ht = int(g[use].sum()), int(h[use].sum())
                for f in range(x.shape[1]):
                    for missing_left in (False, True) if (use & (x[:, f] == MISSING)).any() else (False,):
                        for b in range(1, bins - 1):
                            left = use & (((x[:, f] <= b) & (x[:, f] != MISSING)) | (missing_left & (x[:, f] == MISSING)))
                            gl, hl, n = int(g[left].sum()), int(h[left].sum()), int(left.sum())
                            if not n or n == use.sum():
                                continue
                            gl, hl, gr, hr = gl / scale, hl / scale, (gt - gl) / scale, (ht - hl) / scale
                            vl, vr = leaf(gl, hl, low, high), leaf(gr, hr, low, high)
                            gain = worth(gl, hl, vl) + worth(gr, hr, vr) - worth(gt / scale, ht / scale, leaf(gt / scale, ht / scale, low, high))
                            if min(hl, hr) < p.child_weight or gain <= max(p.gain, 1e-9) or rising[f] * (vr - vl) < 0:
                                continue
                            if best is None or gain > best[0]:
                                best = (gain, f, b, missing_left, vl, vr)
            if best is None:
                value[rows] = own
                return
            _, f, b, missing_left, vl, vr = best
            left = rows & (((x[:, f] <= b) & (x[:, f] != MISSING)) | (missing_left & (x[:, f] == MISSING)))
            middle = (vl + vr) / 2
            grow(left, depth + 1, middle if rising[f] < 0 else low, middle if rising[f] > 0 else high, vl)
            grow(rows & ~left, depth + 1, middle if rising[f] > 0 else low, middle if rising[f] < 0 else high, vr)

        grow(np.ones(len(y), bool), 0, -np.inf, np.inf, 0.0)
        raw = raw + p.rate * value
        out.append(raw)
    return out


@pytest.mark.parametrize("p", [Parameters(rounds=6, depth=3, bins=8, rate=0.3), Parameters(rounds=4, depth=2, bins=6, lasso=0.5, gain=0.2, child_weight=3.0, ridge=0.1, positive=2.5, rising={"a": 1, "b": -1})])
def test_equal_to_plain_boosting(spark, p):
    data = rows(160)
    df = table(spark, data)
    model, scores = cross_validated(df, FEATURES, p, folds=5, whole=True)
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in data])
    y, fold = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    bins, w = binned(x, model.edges), np.where(y == 1, p.positive, 1.0)
    got = {r["row_id"]: r["p"] for r in scores.collect()}
    for m in model.models:
        seen = np.ones(len(y), bool) if m.held is None else fold != m.held[1]
        share = w[seen & (y == 1)].sum() / w[seen].sum()
        raw = plain_boosting(bins, y, w, seen, p, model.edges, [p.rising.get(f, 0) for f in FEATURES], float(np.log(share / (1 - share))))
        assert len(m.trees) == p.rounds and (m.held is None) == (not m.curve)
        if m.held is not None:
            want = 1 / (1 + np.exp(-raw[m.best - 1]))
            for i in np.flatnonzero(fold == m.held[1]):
                assert got[i] == pytest.approx(want[i], abs=1e-9)
            order = np.rint(raw[m.best - 1][fold == m.held[1]] * boosting.STEPS)
            pos, neg = order[y[fold == m.held[1]] == 1], order[y[fold == m.held[1]] == 0]
            auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
            assert m.curve[m.best - 1] == pytest.approx(auc) and max(m.curve) == m.curve[m.best - 1]
    again = {r["row_id"]: r["p"] for r in predict(model, df).collect()}
    assert again == got
    assert scorer_of(model, 5)(x) == pytest.approx(1 / (1 + np.exp(-raw[-1])), abs=1e-9)


def test_rising_and_falling_features(spark):
    rng = random.Random(4)
    data = [(i, int(rng.random() < 0.5 + 0.3 * np.sin(3 * (a := rng.uniform(-2, 2)))), 0, a, float(rng.randrange(4)), None) for i in range(600)]
    p = Parameters(rounds=8, depth=3, rate=0.5, bins=32, rising={"a": 1, "b": -1})
    model, _ = fit(table(spark, data), FEATURES, p)
    free, _ = fit(table(spark, data), FEATURES, Parameters(rounds=8, depth=3, rate=0.5, bins=32))
    grid = np.linspace(-2.5, 2.5, 200)
    for b in range(4):
        x = np.stack([grid, np.full(200, b), np.full(200, np.nan)], axis=1)
        assert (np.diff(scorer_of(model)(x)) >= 0).all() and (np.diff(scorer_of(free)(x)) < 0).any()
    for a in (-1.5, 0.2, 1.9):
        x = np.array([[a, b, np.nan] for b in np.linspace(-1, 4, 30)])
        assert (np.diff(scorer_of(model)(x)) <= 0).all()
    assert scorer_of(model)(np.array([[2.0, 1, np.nan]])) > scorer_of(model)(np.array([[-2.0, 1, np.nan]]))


def test_early_stop_gains_and_dealing(spark):
    data = rows(300, seed=3)
    p = Parameters(rounds=16, depth=3, rate=0.9, bins=16, patience=3, metric="logloss", rows=0.8, columns=0.7)
    model, scores = cross_validated(table(spark, data), FEATURES, p, folds=5)
    for m in model.models:
        assert len(m.curve) == len(m.trees) and m.best == 1 + int(np.argmax(m.curve))
        assert not m.done or len(m.curve) - m.best == 3
    assert any(m.done for m in model.models)
    one, one_scores = cross_validated(table(spark, data).coalesce(1), FEATURES, p, folds=5)
    key = lambda t: sorted((r["row_id"], r["fold"], r["y"], r["p"]) for r in t.collect())
    assert key(scores) == key(one_scores) and len(key(scores)) == 300
    assert importance(one) == importance(model) and sum(v for _, v in importance(model)) == pytest.approx(1)
    total = dict(importance(model, "total"))
    assert total["a"] > total["c"] and dict(importance(model))["a"] > 0
    best = curves(model, spark).where("is_best").collect()
    assert sorted(r["fold"] for r in best) == [0, 1, 2, 3, 4]
    ids = np.arange(20000)
    assert abs(drawn(ids, 1, 0.7, 42).mean() - 0.7) < 0.02 and (drawn(ids, 1, 0.7, 42) != drawn(ids, 2, 0.7, 42)).any()


def test_no_rows_one_class_and_nulls(spark):
    data = rows(20)
    few = Parameters(rounds=2)
    model, scores = fit(table(spark, data).limit(0), FEATURES, few)
    assert scores.collect() == [] and scorer_of(model)(np.zeros((1, 3))).tolist() == [0.5]
    model, scores = fit(table(spark, [(r[0], 1, *r[2:]) for r in data]), FEATURES, few)
    assert all(r["p"] > 0.999 for r in scores.collect()) and not any(t.gain for m in model.models for t in m.trees)
    model, scores = cross_validated(table(spark, [(r[0], None if r[0] < 5 else r[1], *r[2:]) for r in data]), FEATURES, Parameters(rounds=2), folds=5)
    assert scores.count() == 15
    with pytest.raises(ValueError):
        Parameters(bins=1)


def test_split_gains(spark):
    data = rows(200, seed=9)
    p = Parameters(bins=8)
    got = {(r["feature"], r["at"], r["missing_left"]): r["gain"] for r in split_gains(table(spark, data), FEATURES, p).collect()}
    model, _ = fit(table(spark, data), FEATURES, Parameters(rounds=1, depth=1, bins=8))
    first = model.models[0].trees[0]
    assert max(got.values()) == pytest.approx(first.gain[0][1])
    assert {k[0] for k in got} <= set(FEATURES)


def test_several_columns_of_folds_are_fits_of_their_own(spark):
    data = rows(120, seed=5)
    df = table(spark, data).withColumnRenamed("fold", "one").withColumn("two", F.col("row_id") % 3)
    p = Parameters(rounds=5, bins=8)
    both, scores = fit(df, FEATURES, p, [("one", 0), ("two", 1), None])
    single, alone = fit(df.withColumn("fold", F.col("two")), FEATURES, p, [1], both.edges)
    assert [t.gain for t in both.models[1].trees] == [t.gain for t in single.models[0].trees]
    got = sorted((r["row_id"], r["p"]) for r in scores.where("model = 1").collect())
    assert got == sorted((r["row_id"], r["p"]) for r in alone.where("p is not null").collect()) and len(got) == 40
    assert {r["model"]: r["count"] for r in scores.groupBy("model").count().collect()} == {0: 24, 1: 40, 2: 120}


def test_models_with_parameters_of_their_own(spark):
    df = table(spark, rows(150, seed=7))
    ps = [Parameters(rounds=4, depth=2, bins=8), Parameters(rounds=7, depth=3, bins=8, rate=0.4, positive=3.0, patience=2, rows=0.7), Parameters(rounds=2, depth=1, bins=8, rising={"a": 1})]
    both, scores = fit(df, FEATURES, ps, [1, 1, None])
    for k, (p, h) in enumerate(zip(ps, [1, 1, None])):
        one, alone = fit(df, FEATURES, p, [h], both.edges)
        assert [t.gain for t in one.models[0].trees] == [t.gain for t in both.models[k].trees] and one.models[0].best == both.models[k].best
        want = sorted((r["row_id"], r["p"]) for r in alone.where("p is not null").collect())
        assert sorted((r["row_id"], r["p"]) for r in scores.where(F.col("model") == k).collect()) == want


def test_search_grows_trials_together(spark):
    df = table(spark, rows(120, seed=8))
    got = models.search(df.drop("fold"), FEATURES, trials=3, folds=3, rounds=(3, 6), patience=2, together=2).orderBy("trial").collect()
    assert [r["trial"] for r in got] == [0, 1, 2] and got[0]["is_best"] and len({r["rate"] for r in got}) == 3
    best = 0.0
    for r in got:
        assert r["is_best"] == (r["auc"] > best) and 3 <= r["depth"] <= 8 and r["best_round"] <= r["rounds"]
        best = max(best, r["auc"])
    alike = models.sample_parameters(3, compat=True)
    assert alike[0] == alike[2] and models.sample_parameters(2)[0] != models.sample_parameters(2)[1]
