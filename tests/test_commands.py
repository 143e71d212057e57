import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.__main__ import run
from riskloom.plans import boosting, linear, models, networks, store


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, int(a + b + rng.gauss(0, 0.5) > 0.4), a, b))
    path = f"{tmp_path_factory.mktemp('matrix')}/m.parquet"
    spark.createDataFrame(rows, "row_id bigint, y int, a double, b double").write.parquet(path)
    return path


def test_splits_search_stack_and_train(spark, matrix, tmp_path):
    run(spark, ["splits", "--matrix", matrix, "--out", f"{tmp_path}/splits"])
    got = {r["split"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/splits").groupBy("split").count().collect()}
    assert sum(got.values()) == 160 and abs(got["train"] - 112) <= 2
    run(spark, ["search", "--matrix", matrix, "--out", f"{tmp_path}/trials", "--trials", "2", "--folds", "2", "--rounds", "2", "4", "--patience", "2"])
    trials = spark.read.parquet(f"{tmp_path}/trials")
    best = models.best_parameters(trials)
    assert trials.count() == 2 and best.rate in {r["rate"] for r in trials.collect()}
    kept = models.for_stacking(best)
    assert kept.positive == 1.0 and kept.patience is None and kept.every_round and kept.depth == best.depth
    run(spark, ["stack", "--matrix", matrix, "--trials", f"{tmp_path}/trials", "--out", f"{tmp_path}/stack", "--folds", "2", "--rounds", "3", "--epochs", "3"])
    assert spark.read.parquet(f"{tmp_path}/stack/oof").count() == 160
    assert spark.read.parquet(f"{tmp_path}/stack/metrics").first()["auc"] > 0.8
    run(spark, ["train", "--matrix", matrix, "--out", f"{tmp_path}/trees", "--folds", "2", "--rounds", "4"])
    assert {r["part"] for r in spark.read.parquet(f"{tmp_path}/trees/report").collect()} == {"fold0", "fold1", "oof", "mean", "sd"}
    assert isinstance(store.load(spark, f"{tmp_path}/trees/model"), boosting.Ensemble)


def test_models_are_read_back_as_they_were(spark, matrix, tmp_path):
    df = spark.read.parquet(matrix)
    trees, _ = boosting.fit(df, ["a", "b"], boosting.Parameters(rounds=3, rising={"a": 1}))
    net = networks.Perceptron(2, (4,))
    fitted, scores = networks.fit(df, ["a", "b"], net, networks.Training(epochs=2, block=64))
    lines, _ = linear.fit(df.withColumn("part", F.col("row_id") % 3), ["a", "b"], held=[None, ("part", 1)])
    for name, model in (("trees", trees), ("net", [net, fitted]), ("lines", lines)):
        store.save(spark, model, f"{tmp_path}/{name}")
    x = np.random.default_rng(1).normal(size=(30, 2))
    assert boosting.scorer_of(store.load(spark, f"{tmp_path}/trees"))(x).tolist() == boosting.scorer_of(trees)(x).tolist()
    same_net, same = store.load(spark, f"{tmp_path}/net")
    assert same_net == net and same[0].scores(net, x).tolist() == fitted[0].scores(net, x).tolist()
    got = {r["row_id"]: r["p"] for r in networks.predict(same, same_net, df, ["a", "b"]).collect()}
    assert got == pytest.approx({r["row_id"]: r["p"] for r in scores.collect()})
    back = store.load(spark, f"{tmp_path}/lines")
    assert back[1].held == ("part", 1) and back[1].w.tolist() == lines[1].w.tolist()
    assert store.scaler(fitted[0], ["a", "b"])["a"]["mean"] == pytest.approx(fitted[0].mean[0])


def test_discover_and_features(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, int(rng.random() < 0.15), rng.choice([0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), rng.gauss(0, 1), rng.gauss(5, 2), float(rng.randrange(9))) for i in range(300)]
    spark.createDataFrame(rows, "row_id bigint, default_flag int, overdue_flag double, income double, age double, visits double").write.parquet(f"{tmp_path}/d.parquet")
    words = [("default_flag", "defaulted loans last 6 month"), ("overdue_flag", "overdue flag last 12 month"), ("income", "income"), ("age", "age"), ("visits", "number of visits")]
    spark.createDataFrame(words, "variable string, description string").write.option("header", True).csv(f"{tmp_path}/words.csv")
    run(spark, ["discover", "--data", f"{tmp_path}/d.parquet", "--dictionary", f"{tmp_path}/words.csv", "--out", f"{tmp_path}/found"])
    labels = spark.read.parquet(f"{tmp_path}/found/labels")
    assert labels.count() == 300 and "label_union" in labels.columns
    run(spark, ["features", "--data", f"{tmp_path}/d.parquet", "--dictionary", f"{tmp_path}/words.csv", "--labels", f"{tmp_path}/found/labels", "--out", f"{tmp_path}/made"])
    made = spark.read.parquet(f"{tmp_path}/made/matrix")
    assert made.count() == 300 and {"row_id", "y", "age"} <= set(made.columns) and "default_flag" not in made.columns
    with pytest.raises(SystemExit):
        run(spark, ["train", "--out", "x"])
