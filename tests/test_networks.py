import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.plans import boosting, models, networks
from riskloom.plans.networks import AdamW, Attention, Perceptron, Training, cross_validated, fit, loss_and_gradients, rate_of

FEATURES = ["a", "b", "c"]


def table(spark, n, seed=1, partitions=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(5, 3)
        rows.append((i, int(a + 0.3 * (b - 5) * abs(a) + rng.gauss(0, 0.3) > 0), i * 3 % 5, a, b, rng.choice([None, float("nan"), 1.0, 2.0])))
    return spark.createDataFrame(rows, "row_id bigint, y int, fold int, a double, b double, c double").repartition(partitions)


@pytest.mark.parametrize("net", [Perceptron(3, (5, 4), 0.3), Attention(3, width=6, layers=2, heads=3, drop=0.2, feature_drop=0.2)])
def test_gradients_are_slopes(net):
    rng = np.random.default_rng(3)
    params = {k: v + 0.3 * rng.standard_normal(v.shape) for k, v in net.start(rng).items()}
    x, y = rng.standard_normal((7, 3)), np.array([0, 1, 1, 0, 1, 0, 0])
    at = lambda p: loss_and_gradients(net, p, x, y, 2.5, np.random.default_rng(9))
    _, gradients, _ = at(params)
    assert gradients.keys() == params.keys()
    for name, g in gradients.items():
        for place in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
            step = np.zeros_like(params[name])
            step[place] = 1e-5
            slope = (at(params | {name: params[name] + step})[0] - at(params | {name: params[name] - step})[0]) / 2e-5
            assert g[place] == pytest.approx(slope, rel=1e-4, abs=1e-6), (name, place)


def test_one_step_of_adamw():
    a = AdamW(2, decay=0.1, clip=0)
    assert a.step(np.array([1.0, -2.0]), np.array([0.5, -4.0]), 0.01) == pytest.approx([1 * (1 - 0.001) - 0.01, -2 * (1 - 0.001) + 0.01], abs=1e-6)
    clipped, plain = AdamW(2, 0, 1.0), AdamW(2, 0, 0)
    clipped.step(np.zeros(2), np.array([30.0, 40.0]), 0.1)
    plain.step(np.zeros(2), np.array([0.6, 0.8]), 0.1)
    assert clipped.m == pytest.approx(plain.m)


def test_schedule_is_the_column_function(spark):
    t = Training(rate=1e-3, least_rate=1e-6, warm=0.1)
    got = [r[0] for r in spark.range(1, 101).select(models.cosine_warmup(F.col("id"), 100, warm=0.1)).collect()]
    assert got == pytest.approx([rate_of(i, 100, t) for i in range(1, 101)])


def auc(rows):
    pos, neg = [r["p"] for r in rows if r["y"] == 1], [r["p"] for r in rows if r["y"] == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.mark.parametrize("net, t", [(Perceptron(3, (16, 8), 0.1), Training(epochs=8, block=100, rate=0.03, patience=4)), (Attention(3, width=8, layers=1, heads=2), Training(epochs=10, block=100, rate=0.03, blocks=2))])
def test_learns_and_is_the_same_for_every_dealing(spark, net, t):
    fitted, scores = cross_validated(table(spark, 400), FEATURES, net, t)
    rows = scores.collect()
    assert len(rows) == 400 and auc(rows) > 0.85
    for m in fitted:
        assert len(m.curve) <= t.epochs and m.curve[m.best - 1] >= max(m.curve) - 1e-5 and m.sd[1] == pytest.approx(3, abs=0.5)
        own = [r for r in rows if r["fold"] == m.held]
        assert auc(own) == pytest.approx(m.curve[m.best - 1], abs=0.02)
    again, other = cross_validated(table(spark, 400, partitions=1).coalesce(1), FEATURES, net, t)
    assert [r["p"] for r in sorted(other.collect())] == pytest.approx([r["p"] for r in sorted(rows)], abs=1e-6)  # by row_id


def test_early_stop_one_class_and_no_rows(spark):
    df = table(spark, 120)
    net = Perceptron(3, (4,), 0.0)
    fitted, _ = cross_validated(df, FEATURES, net, Training(epochs=20, block=60, rate=0.5, patience=2), whole=True)
    assert any(m.done and len(m.curve) - m.best == 2 for m in fitted[:-1]) and fitted[-1].curve == []
    _, scores = fit(df.withColumn("y", F.lit(1)), FEATURES, net, Training(epochs=2))
    assert scores.count() == 120 and scores.where("p is null or isnan(p)").count() == 0
    _, scores = fit(df.limit(0), FEATURES, net, Training(epochs=2))
    assert scores.collect() == []
    _, scores = fit(df.withColumn("y", F.when(F.col("row_id") > 9, F.col("y"))), FEATURES, net, Training(epochs=1))
    assert scores.count() == 110


@pytest.mark.parametrize("model", [boosting.Parameters(rounds=6, patience=3, bins=8), (Perceptron(3, (8,), 0.0), Training(epochs=6, block=64, rate=0.05))])
def test_run_on_train_val_and_test(spark, model):
    got = {r["part"]: r for r in models.early_stopped_run(table(spark, 400), FEATURES, model).collect()}
    assert set(got) == {"val", "test", "test_calibrated"} and got["test"]["auc"] > 0.75
    assert got["test_calibrated"]["auc"] == pytest.approx(got["test"]["auc"]) and got["test_calibrated"]["logloss"] < 0.69


@pytest.mark.parametrize("net, blocks", [(Perceptron(3, (5,), 0.1), 1), (Attention(3, width=4, layers=1, heads=2), 2)])
def test_legs_take_the_steps_of_single_jobs(spark, monkeypatch, net, blocks):
    """An epoch is some legs instead of a job for each step, and the models are the same to the last bit."""
    t, sc, seen = Training(epochs=2, block=20, blocks=blocks, rate=0.03), spark.sparkContext, {}
    for leg in (64, 6, 0):  # none: a job for each step
        monkeypatch.setattr(networks, "LEG", leg)
        sc.setJobGroup(f"legs-{leg}-{blocks}", "")
        fitted, scores = cross_validated(table(spark, 400), FEATURES, net, t, whole=True)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"legs-{leg}-{blocks}"))
        seen[leg] = jobs, [(r["row_id"], r["p"]) for r in sorted(scores.collect())], [m.curve for m in fitted]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen[64][1:] == seen[6][1:] == seen[0][1:]
    assert seen[0][0] - seen[64][0] == 2 * (20 // blocks - 1) and seen[6][0] - seen[64][0] == 2 * (-(-20 // 6) - 1)
