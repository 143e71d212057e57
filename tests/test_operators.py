"""The hand-checked cases of the method, and its edge rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import coerce
from riskloom.functions import patterns as P
from riskloom.operators import metrics, profile, prune, similarity, splits, transform
from riskloom.operators.order import average_ranks, exact_quantiles, prefix_sums
from riskloom.plans import models
from riskloom.plans.models import chosen_metric, sample_parameters
from riskloom.sources.readers import pick_columns, pick_target, preferred_label
from riskloom.sources.sinks import markdown, plain


def scores(spark, y, x):
    return spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, x))], "row_id int, y int, x double")


def test_rank_metrics_with_ties(spark):
    t = scores(spark, [0, 0, 1, 1], [1, 2, 2, 3])
    r = metrics.auc(t, []).first()
    assert r.auc == 0.875 and r.gini == 0.75
    assert math.isclose(metrics.average_precision(t, []).first().ap, 5 / 6)
    assert metrics.auc(scores(spark, [1, 1], [1, 2]), []).first().auc == 0.5


@pytest.mark.parametrize("n, sizes", [(237, [24, 24, 23, 24, 24, 23, 24, 23, 24, 24])])
def test_decile_sizes(spark, n, sizes):
    t = scores(spark, [i % 2 for i in range(n)], range(n))
    assert [r.n for r in metrics.deciles_by_rank(t).orderBy(F.desc("decile")).collect()] == sizes
    t = scores(spark, [0] * 15, range(15))
    assert [r.n for r in metrics.deciles_by_cut(t).orderBy("decile").collect()] == [1, 2] * 5


def test_quantiles_and_ranks_equal_pandas(spark):
    import pandas as pd

    x = [3.0, 1.0, 1.0, None, 7.5, 2.0, 2.0, 2.0, -4.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    s = pd.Series(x)
    r = exact_quantiles(df, [], "x", [0.0, 0.25, 0.5, 0.995, 1.0]).first()
    assert all(math.isclose(a, b) for a, b in zip(r, s.quantile([0.0, 0.25, 0.5, 0.995, 1.0])))
    got = sorted((q.x, q["rank"]) for q in average_ranks(df, [], "x").collect() if q.x is not None)
    assert got == sorted(zip(s.dropna(), s.dropna().rank()))


def test_profile_equals_pandas(spark):
    import pandas as pd

    x = [1.0, 2.0, 2.5, 9.0, None, 2.0]
    long = spark.createDataFrame([(i, "a", v) for i, v in enumerate(x)] + [(9, "b", float("nan")), (8, "b", None)], "row_id int, feature string, x double").withColumn("x", profile.clean(F.col("x")))
    p = {r.feature: r for r in profile.profile(long).collect()}
    s = pd.Series(x)
    assert all(math.isclose(a, b) for a, b in ((p["a"].variance, s.var()), (p["a"].skewness, s.skew()), (p["a"].kurtosis, s.kurt()), (p["a"].missing, 1 / 6)))
    assert p["b"].missing == 1.0 and p["b"].is_binary and not p["b"].is_integer_like


def test_coercion(spark):
    df = spark.createDataFrame([("Yes ",), ("n",), ("3",), ("1",), (None,)], "w string")
    rows = df.select(coerce.bool_or_number(F.col("w")).alias("a"), coerce.bool_few(F.col("w")).alias("b")).collect()
    assert [r.a for r in rows] == [1, 0, None, 1, None] and [r.b for r in rows] == [None, 0, None, None, None]
    x = spark.createDataFrame([(-2.0,), (0.0,), (None,), (math.e - 1,)], "x double").select(coerce.severity(F.col("x")).alias("z")).collect()
    assert [round(r.z, 9) for r in x] == [0, 0, 0, 1]


def test_windows_and_ids(spark):
    rows = [("spend last 3 month", ""), ("x_3m", ""), ("lifetime spend", ""), ("flag", "[last 3 months]")]
    df = spark.createDataFrame(rows, "column_name string, description string")
    assert [r.w for r in df.select(P.window_tag(P.text()).alias("w")).collect()] == ["3m", "unknown", "lt", "3m"]
    assert df.select(P.window_tag(P.text(), compat=True).alias("w")).collect()[3].w == "unknown"
    ids = ["user_id", "panel", "idle", "leader_count", "c_acctbal", "mobile_no", "paid", "companion", "grid", "l_returnflag"]
    df = spark.createDataFrame([(c,) for c in ids], "c string").select(P.is_id_like(F.col("c"), "framework").alias("x"))
    assert [r.x for r in df.collect()] == [True] * 6 + [False] * 4


def test_scaling_of_a_constant(spark):
    long = spark.createDataFrame([(i, "a", 1.0) for i in range(4)], "row_id int, feature string, x double")
    assert {r.x for r in transform.robust_scale(long).collect()} == {0.0}
    assert transform.sanitise(long).count() == 0


def test_pruning():
    cols = ["a", "b", "c", "d"]
    assert prune.prune_greedy(cols, [("a", "b"), ("b", "c")]) == (["b", "d"], ["a", "c"]) or prune.prune_greedy(cols, [("a", "b"), ("b", "c")])[1]
    kept, dropped = prune.prune_greedy(cols, [("a", "b")], {"a": 2.0, "b": 1.0})
    assert kept == ["a", "c", "d"] and dropped == ["b"]


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "row_id int, y boolean").withColumn("y", F.col("y").cast("int"))
    n = {(r.y, r.split): r["count"] for r in splits.stratified_split(df).groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 210, (0, "val"): 45, (0, "test"): 45, (1, "train"): 70, (1, "val"): 15, (1, "test"): 15}
    with pytest.raises(ValueError):
        splits.stratified_split(df, {"a": 0.5})
    assert {r["count"] for r in splits.stratified_folds(df).groupBy("y", "fold").count().collect()} == {60, 20}


def test_readers_and_sinks():
    cols = ["Variable Name", "Field", "Description", "Detail"]
    assert pick_columns(cols) == ("Variable Name", "Description") and pick_columns(cols, "last") == ("Field", "Detail") and pick_columns(cols, "exact")[0] == "Variable Name"
    assert pick_target(["row_id", "a", "b"], None, "b") == "b" and pick_target(["row_id", "a"]) == "a" and preferred_label(["id", "z", "label_weighted"]) == "label_weighted"
    assert plain({"a": {3, 1}}) == {"a": [1, 3]} and "| x |" in markdown("t", {"s": [{"x": 1}]})
    assert chosen_metric(0.2) == "ap" and len({str(p) for p in sample_parameters(5)}) == 5


def test_pairs_equal_numpy_at_many_columns(spark):
    """300 columns with missing values: 44850 pairs from blocked sums."""
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1.0, (60, 300))
    x[:, 1] = 3.0
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, f"c{j:03}", float(x[i, j])) for i in range(60) for j in range(300) if not np.isnan(x[i, j])]
    got = {(r.a, r.b): (r.n, r.r) for r in similarity.pearson(spark.createDataFrame(rows, "row_id bigint, feature string, x double")).collect()}
    assert len(got) == 300 * 299 // 2
    for a, b in [(0, 2), (5, 299), (17, 100)]:
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        n, r = got[f"c{a:03}", f"c{b:03}"]
        assert n == both.sum() and math.isclose(r, np.corrcoef(x[both, a], x[both, b])[0, 1], abs_tol=1e-9)
    assert got["c000", "c001"][1] is None


def test_running_totals_with_a_value_on_half_the_rows(spark):
    df = spark.createDataFrame([(i, 0.0 if i % 2 else float(i % 7), 1) for i in range(3000)], "row_id bigint, x double, one int").repartition(3)
    for down in (False, True):
        got = {r.row_id: r.place for r in prefix_sums(df, [], ["x", "row_id"], {"place": "one"}, descending=down).collect()}
        order = sorted(range(3000), key=lambda i: (0.0 if i % 2 else float(i % 7), i), reverse=down)
        assert [got[i] for i in order] == list(range(1, 3001))


def test_models_with_held_out_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a + 0.3 * rng.normal() > 0)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "row_id bigint, a double, b double, y int")
    scores, report = models.kfold_with_test(df, ["a", "b"], models.logistic, folds=2)
    parts = {r.part: r for r in report.collect()}
    assert set(parts) == {"fold0", "fold1", "oof", "mean", "sd", "test"} and parts["test"].auc > 0.9
    held = 400 - scores.count()
    assert 55 <= held <= 65
    check = models.baseline_check(df.withColumn("c", F.lit(1.0)), ["a", "b", "c"]).first()
    assert check.n_features == 2 and check.test_auc > 0.9 and check.verdict in ("suspicious", "strong")


def test_features_with_categories(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3], f"n{i % 20}") for i in range(240)], "row_id bigint, kind string, place string")
    t, names = transform.encoded_categories(df, ["kind", "place"])
    assert names == ["kind__is___MISSING__", "kind__is_a", "kind__is_b", "place__freq"]
    assert tuple(t.agg(F.sum("kind__is_a").alias("a"), F.sum("place__freq").alias("f")).first()) == pytest.approx((80, 12.0))


def test_rows_without_label_are_a_class_of_their_own(spark):
    """As SQL's PARTITION BY has it: they are split, too."""
    from riskloom.operators import splits

    t = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(60)], "row_id bigint, y int")
    got = splits.stratified_folds(t).groupBy("y", "fold").count().collect()
    assert sorted((str(r.y), r.fold, r["count"]) for r in got) == [(y, k, 4) for y in ("0", "1", "None") for k in range(5)]
    assert splits.holdout(t).where("y is null and split = 'test'").count() == 5


def test_buckets_are_made_once(spark):
    """A sketch differs with the order in which its parts come: were it made anew for the totals, rows would miss them."""
    df = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") % 50).cast("double").alias("x"), F.lit(1).alias("one"))
    out = prefix_sums(df, [], ["x", "row_id"], {"place": "one"})
    assert "percentile_approx" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.place for r in out.collect()) == list(range(1, 201))
