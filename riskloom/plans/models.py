"""Models on pyspark.ml: cross-validated out-of-fold scores, stacking, calibration, importances, parameter search.

Estimators keep the method's interface and metrics; coefficients differ from other libraries'. Folds and scores are written once
and read again (see scratch), so that plans over them stay small. Boosting with early stopping and rising or falling features is in boosting, networks
trained by mini-batches in networks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import metrics
from ..operators.guard import auc_band
from ..operators.order import prefix_sums
from ..operators.splits import stratified_folds, stratified_split
from ..scratch import dropped, written
from . import boosting, linear, networks


def logistic(elastic: float = 0.5, reg: float = 0.01) -> LogisticRegression:
    """A logistic model; its fit has no randomness."""
    return LogisticRegression(labelCol="y", elasticNetParam=elastic, regParam=reg, maxIter=100, weightCol="weight")


def boosted(depth: int = 3, trees: int = 20, rate: float = 0.1, bins: int = 32, seed: int = DEFAULTS.seed, validation: str | None = None) -> GBTClassifier:
    """Boosted trees; with validation (a boolean column) they stop early."""
    gbt = GBTClassifier(labelCol="y", maxDepth=depth, maxIter=trees, stepSize=rate, maxBins=bins, seed=seed, weightCol="weight")
    return gbt.setValidationIndicatorCol(validation) if validation else gbt


def perceptron(inputs: int, hidden: tuple[int, ...] = (128, 64), seed: int = DEFAULTS.seed) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol="y", layers=[inputs, *hidden, 2], maxIter=60, seed=seed)


def pipeline(features: list[str], estimator: Estimator, scale: bool = True) -> Pipeline:
    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep")]
    if scale:
        steps.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    else:
        steps[0].setOutputCol("features")
    return Pipeline(stages=[*steps, estimator])


def prepared(df: DataFrame, features: list[str], balanced: bool = True) -> DataFrame:
    """row_id, y as double, features without nulls, weight (balanced classes)."""
    t = df.select("row_id", F.col("y").cast("double").alias("y"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), *(c for c in ("fold", "split") if c in df.columns))
    n = {r["y"]: r["count"] for r in t.groupBy("y").count().collect()}
    whole, classes = sum(n.values()), max(1, len(n))
    weight = F.when(F.col("y") == 1, whole / (classes * n.get(1.0, 1) or 1)).otherwise(whole / (classes * n.get(0.0, 1) or 1))
    return t.withColumn("weight", weight if balanced else F.lit(1.0))


def scored(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select("row_id", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def out_of_fold(df: DataFrame, features: list[str], estimator: Callable[[], Estimator], folds: int = 5, seed: int = DEFAULTS.seed, scale: bool = True) -> DataFrame:
    """row_id, fold, y, p, written: each row scored by the model that hasn't seen its fold."""
    t = written(prepared(df if "fold" in df.columns else stratified_folds(df, folds, seed), features), "folds")
    out = None
    for k in range(folds):
        model = pipeline(features, estimator(), scale).fit(t.where(F.col("fold") != k))
        part = scored(model, t.where(F.col("fold") == k)).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    out = written(out.select("row_id", "fold", "y", "p"), "out-of-fold")
    dropped(t)
    return out


def platt(scores: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """scores (row_id, y, p) with calibrated: a logistic regression on p, fitted on train or on scores themselves."""
    assemble = VectorAssembler(inputCols=["p"], outputCol="features")
    fit = LogisticRegression(labelCol="y", regParam=0.0, maxIter=100).fit(assemble.transform(train if train is not None else scores))
    return fit.transform(assemble.transform(scores)).select("row_id", "y", "p", vector_to_array("probability")[1].alias("calibrated"))


def stacked(parts: dict[str, DataFrame], nested: bool = False, folds: int = 5, seed: int = DEFAULTS.seed) -> tuple[DataFrame, list[float], float]:
    """row_id, y, a column for each model's out-of-fold score, and oof_stack; the coefficients and the intercept. nested: the stacker's own scores are out of fold."""
    names = list(parts)
    t = None
    for n, d in parts.items():
        d = d.select("row_id", *(["y"] if t is None else []), F.col("p").alias(f"oof_{n}"))
        t = d if t is None else t.join(d, "row_id")
    t = written(t, "stack")
    features = [f"oof_{n}" for n in names]
    whole = pipeline(features, LogisticRegression(labelCol="y"), scale=False).fit(prepared(t, features, balanced=False))
    last = whole.stages[-1]
    score = out_of_fold(t, features, lambda: LogisticRegression(labelCol="y"), folds, seed, scale=False) if nested else scored(whole, prepared(t, features, balanced=False))
    return t.join(score.select("row_id", F.col("p").alias("oof_stack")), "row_id"), list(last.coefficients), float(last.intercept)


def l1_importance(df: DataFrame, features: list[str], share: float = 0.25, seed: int = DEFAULTS.seed) -> tuple[DataFrame, float]:
    """feature, importance (absolute coefficient on scaled features); and the AUC on a holdout."""
    t = written(prepared(stratified_split(df, {"valid": share, "train": 1 - share}, seed), features), "split")
    model = pipeline(features, logistic(1.0)).fit(t.where("split = 'train'"))
    rows = [(f, abs(float(c))) for f, c in zip(features, model.stages[-1].coefficients)]
    valid = scored(model, t.where("split = 'valid'")).withColumnRenamed("p", "x")
    return df.sparkSession.createDataFrame(rows, "feature string, importance double"), metrics.auc(valid, []).first()["auc"]


def permuted_auc(df: DataFrame, features: list[str], score: Callable[[np.ndarray], np.ndarray], repeats: int = 5, seed: int = DEFAULTS.seed) -> DataFrame:
    """feature, repeat, auc, base_auc: of score over the rows of df (row_id, y, features) when the feature's values trade places, and when none do.

    score takes a matrix of doubles (nulls are NaN), a row for each row. Rows are placed once, in order of md5(row_id|seed); the value that a row
    gets for a feature is the one some number of places on, another number for each feature and repeat. Each row meets its new values in one join,
    all variants are scored in one pass, and their AUCs come from one count. With one row there is nothing to trade.
    """
    key = F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(seed))))
    rows = df.select("row_id", F.col("y").cast("int").alias("y"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    rows = rows.withColumns({"_key": key, "_head": F.conv(F.substring(key, 1, 12), 16, 10).cast("double"), "_one": F.lit(1)})
    rows = written(prefix_sums(rows, [], ["_head", "_key", "row_id"], {"place": "_one"}).select("place", "y", "x"), "placed")
    n = rows.count()
    shifts = [[1 + ((j * repeats + r) * 7919 + seed) % max(1, n - 1) for r in range(repeats)] for j in range(len(features))]
    moves = F.array(*(F.struct(F.lit(j * repeats + r).alias("variant"), F.lit(s).alias("shift"), F.lit(j).alias("at")) for j, own in enumerate(shifts) for r, s in enumerate(own)))
    given = rows.select("place", "x", F.explode(moves).alias("m")).select(((F.col("place") - 1 - F.col("m.shift") + 2 * n) % n + 1).alias("place"), F.struct("m.variant", F.get("x", "m.at").alias("x")).alias("new"))
    given = given.groupBy("place").agg(F.array_sort(F.collect_list("new")).alias("new"))  # a value for each variant
    schema = pa.schema([("variant", pa.int32()), ("y", pa.int32()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nan = float("nan")
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = part.column("x").flatten().fill_null(nan).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                new = part.column("new").flatten().field("x").fill_null(nan).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                for v in range(-1, new.shape[1]):
                    moved = x.copy()
                    if v >= 0:
                        moved[:, v // repeats] = new[:, v]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), v, np.int32)), part.column("y"), pa.array(score(moved))], schema=schema)

    scores = rows.join(given, "place").select("y", "x", "new").mapInArrow(run, "variant int, y int, x double")
    aucs = written(metrics.auc(scores, ["variant"]).select("variant", "auc"), "permuted")
    dropped(rows)
    named = F.element_at(F.array(*(F.lit(f) for f in features)), (F.floor(F.col("variant") / repeats) + 1).cast("int"))
    base = aucs.where("variant = -1").select(F.col("auc").alias("base_auc"))
    return aucs.where("variant >= 0").crossJoin(F.broadcast(base)).select(named.alias("feature"), (F.col("variant") % repeats).alias("repeat"), "auc", "base_auc")


def permutation_importance(df: DataFrame, features: list[str], share: float = 0.25, repeats: int = 5, seed: int = DEFAULTS.seed, p: boosting.Parameters | None = None) -> DataFrame:
    """feature, importance, spread: the AUC that boosted trees lose on a holdout when the feature's values trade places, its mean and deviation over repeats."""
    t = written(stratified_split(df, {"valid": share, "train": 1 - share}, seed).select("row_id", "y", "split", *features), "split")
    train = t.where("split = 'train'")
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    model, _ = boosting.fit(train, features, p or boosting.Parameters(positive=n.get(0, 1) / n.get(1, 1), seed=seed))
    out = permuted_auc(t.where("split = 'valid'"), features, boosting.scorer_of(model), repeats, seed)
    loss = F.col("base_auc") - F.col("auc")
    return out.groupBy("feature").agg(F.avg(loss).alias("importance"), F.stddev_pop(loss).alias("spread"))


def sample_parameters(trials: int, prevalence: float = 0.5, rounds: tuple[int, int] = (800, 2000), seed: int = DEFAULTS.seed, compat: bool = False) -> list[boosting.Parameters]:
    """Random parameters of boosted trees, scales on a logarithmic measure. One generator serves all trials; compat: it begins anew for each, so all trials are alike."""
    out, rng = [], np.random.default_rng(seed)
    for _ in range(trials):
        rng = np.random.default_rng(seed) if compat else rng
        scale = lambda low, high: float(10 ** rng.uniform(low, high))
        # The ranges of the search.
        out.append(boosting.Parameters(
            rate=scale(-2.0, -0.7), depth=int(rng.integers(3, 9)), child_weight=scale(-1, 2), rows=float(rng.uniform(0.6, 1.0)), columns=float(rng.uniform(0.6, 1.0)),
            gain=scale(-3, 1), lasso=scale(-4, 0), ridge=scale(-3, 1), positive=max((1 - prevalence) / max(prevalence, 1e-9), 1.0), rounds=int(rng.integers(*rounds)), seed=seed,
        ))
    return out


def chosen_metric(prevalence: float) -> str:
    """ap for labels of at most 20 %, else auc."""
    return "ap" if prevalence <= 0.20 else "auc"


def best_parameters(trials: DataFrame) -> boosting.Parameters:
    """The parameters of the best trial of search() (the first on ties), as read back from a table of trials."""
    r = trials.orderBy(F.desc("auc"), "trial").first()
    return boosting.Parameters(rate=r["rate"], depth=r["depth"], child_weight=r["child_weight"], rows=r["row_share"], columns=r["column_share"], gain=r["gain"], lasso=r["lasso"], ridge=r["ridge"], positive=r["positive"], rounds=r["rounds"], metric=r["metric"])


def for_stacking(p: boosting.Parameters | None = None) -> boosting.Parameters:
    """p, or the defaults of a stack, without class weight and early stop: out-of-fold scores of a stack come from trees that no held-out row has stopped."""
    p = p or boosting.Parameters(rounds=1200, rate=0.05, depth=6, rows=0.8, columns=0.8, lasso=0.1, ridge=0.5)
    return replace(p, positive=1.0, patience=None, every_round=True)


def search(df: DataFrame, features: list[str], trials: int = 60, folds: int = 5, rounds: tuple[int, int] = (800, 2000), patience: int = 200, together: int = 8, seed: int = DEFAULTS.seed) -> DataFrame:
    """trial, its parameters, the mean of the folds' best rounds, out-of-fold metrics, the metric that stops trees early, and whether the trial's AUC was best so far.

    The trees of all folds of `together` trials grow in the same passes, each model with its own parameters.
    """
    prevalence = df.agg(F.avg("y")).first()[0] or 0.0
    metric = chosen_metric(prevalence)
    t = written(stratified_folds(df, folds, seed).select("row_id", "y", "fold", *features), "folds")
    asked = [replace(p, metric=metric, patience=patience) for p in sample_parameters(trials, prevalence, rounds, seed)]
    rows, best = [], -1.0
    for lo in range(0, trials, together):
        part = asked[lo : lo + together]
        model, scores = boosting.fit(t, features, [p for p in part for _ in range(folds)], [k for _ in part for k in range(folds)])
        scores = scores.select(F.floor(F.col("model") / folds).alias("trial"), "y", F.col("p").alias("x")) if len(part) > 1 else scores.select(F.lit(0).cast("bigint").alias("trial"), "y", F.col("p").alias("x"))
        found = {r["trial"]: r for r in metrics.summary(scores, ["trial"]).collect()}  # a row for each trial
        for i, p in enumerate(part):
            m, own = found[i], model.models[i * folds : (i + 1) * folds]
            rows.append((lo + i, p.rate, p.depth, p.child_weight, p.rows, p.columns, p.gain, p.lasso, p.ridge, p.positive, p.rounds, float(np.mean([x.best for x in own])), *(float(m[c]) for c in ("auc", "ap", "ks", "gini", "brier", "logloss")), metric, m["auc"] > best))
            best = max(best, m["auc"])
    names = "rate double, depth int, child_weight double, row_share double, column_share double, gain double, lasso double, ridge double, positive double, rounds int, best_round double"
    dropped(t)
    return df.sparkSession.createDataFrame(rows, f"trial int, {names}, auc double, ap double, ks double, gini double, brier double, logloss double, metric string, is_best boolean")


def stability_runs(df: DataFrame, features: list[str], seeds: tuple[int, ...] = (0, 1, 2, 3, 4), top: int = 200, share: float = 0.25, repeats: int = 5, p: boosting.Parameters | None = None) -> DataFrame:
    """method, run, feature: the top features under each seed, by absolute coefficients of L1 models and by what boosted trees lose on a holdout when a feature's values trade places.

    The models of all seeds are fitted in the same passes; a seed is a column that says which rows are held out.
    """
    df = t = df.select("row_id", "y", *features)
    for s in seeds:
        out = (F.col("split") == "valid").cast("int").alias(f"out_{s}")
        before, t = t, written(stratified_split(t, {"valid": share, "train": 1 - share}, s).select("row_id", "y", *features, *(f"out_{x}" for x in seeds if f"out_{x}" in t.columns), out), "seeds")
        if before is not df:
            dropped(before)
    held = [(f"out_{s}", 1) for s in seeds]
    lines, _ = linear.fit(t, features, linear.Penalty(lasso=1.0, balanced=True), held)
    n = {r["y"]: r["count"] for r in t.groupBy("y").count().collect()}
    trees, _ = boosting.fit(t, features, p or boosting.Parameters(positive=n.get(0, 1) / max(n.get(1, 1), 1)), held)
    chosen = []
    first = lambda pairs: [f for f, _ in sorted(pairs, key=lambda x: (-x[1], x[0]))[:top]]
    for k, s in enumerate(seeds):
        chosen += [("L1", s, f) for f in first(zip(features, np.abs(lines[k].coefficients).tolist()))]
        moved = permuted_auc(t.where(F.col(f"out_{s}") == 1), features, boosting.scorer_of(trees, k), repeats, s)
        loss = moved.groupBy("feature").agg(F.avg(F.col("base_auc") - F.col("auc")).alias("loss")).collect()
        chosen += [("TREE", s, f) for f in first((r["feature"], r["loss"]) for r in loss)]
    dropped(t)
    return df.sparkSession.createDataFrame(chosen, "method string, run int, feature string")


def repeated_protocol(df: DataFrame, features: list[str], seeds: tuple[int, ...] = (1, 2, 3, 4, 5), folds: int = 5, top: int = 20, penalty: linear.Penalty | None = None, p: boosting.Parameters | None = None) -> DataFrame:
    """model, n_features, auc_mean, auc_sd, ap_mean, ap_sd, top_jaccard: an elastic net and boosted trees under several seeds of folds.

    All seeds and folds are fitted in the same passes, a column of folds for each seed. AUC and AP are of the out-of-fold scores of a seed; top_jaccard is the mean overlap of
    every two seeds' top features, by absolute coefficients and by gains, averaged over the folds.
    """
    df = t = df.select("row_id", "y", *features)
    for s in seeds:
        before, t = t, written(stratified_folds(t, folds, s).withColumnRenamed("fold", f"fold_{s}"), "seeds")
        if before is not df:
            dropped(before)
    held = [(f"fold_{s}", k) for s in seeds for k in range(folds)]
    lines, line_scores = linear.fit(t, features, penalty or linear.Penalty(), held)
    trees, tree_scores = boosting.fit(t, features, p or boosting.Parameters(rounds=300, rate=0.05, depth=3), held)
    own = lambda models, i: models[i * folds : (i + 1) * folds]
    weights = {"logit": [np.mean([np.abs(m.coefficients) for m in own(lines, i)], axis=0) for i in range(len(seeds))]}
    weights["gbt"] = [np.array([g for _, g in sorted(boosting.importance(replace(trees, models=own(trees.models, i)), "total"), key=lambda x: features.index(x[0]))]) for i in range(len(seeds))]
    tops = {m: [{f for f, _ in sorted(zip(features, w.tolist()), key=lambda x: (-x[1], x[0]))[:top]} for w in ws] for m, ws in weights.items()}
    overlaps = lambda sets: [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]] or [1.0]
    jaccards = df.sparkSession.createDataFrame([(m, len(features), float(np.mean(overlaps(sets)))) for m, sets in tops.items()], "model string, n_features int, top_jaccard double")
    scores = line_scores.select(F.lit("logit").alias("name"), "model", "y", F.col("p").alias("x")).unionByName(tree_scores.select(F.lit("gbt").alias("name"), "model", "y", F.col("p").alias("x")))
    scores = written(scores.select(F.col("name"), F.floor(F.col("model") / folds).alias("seed"), "y", "x"), "seed-scores")
    each = metrics.auc(scores, ["name", "seed"]).join(metrics.average_precision(scores, ["name", "seed"]), ["name", "seed"])
    out = each.groupBy(F.col("name").alias("model")).agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_sd"), F.avg("ap").alias("ap_mean"), F.stddev_samp("ap").alias("ap_sd"))
    out = written(out.join(jaccards, "model").select("model", "n_features", "auc_mean", "auc_sd", "ap_mean", "ap_sd", "top_jaccard"), "protocol")
    dropped(t, scores)
    return out


def baseline_check(df: DataFrame, features: list[str], share: float = 0.30, seed: int = DEFAULTS.seed) -> DataFrame:
    """One row: AUC of a logistic model on train and test rows, and what the latter says of leakage. Missing values count as 0; features that hardly vary are left out."""
    t = prepared(stratified_split(df, {"test": share, "train": 1 - share}, seed), features, balanced=False)
    t = written(t, "split")
    spread = t.agg(*(F.var_samp(c).alias(c) for c in features)).first().asDict()
    live = [c for c in features if (spread[c] or 0.0) > DEFAULTS.least_variance]
    model = pipeline(live, LogisticRegression(labelCol="y", maxIter=100)).fit(t.where("split = 'train'"))
    value = {part: metrics.auc(scored(model, t.where(F.col("split") == part)).withColumnRenamed("p", "x"), []).first()["auc"] for part in ("train", "test")}
    return df.sparkSession.createDataFrame([(len(live), value["train"], value["test"])], "n_features int, train_auc double, test_auc double").withColumn("verdict", auc_band(F.col("test_auc")))


def _measured(t: DataFrame) -> DataFrame:
    """metrics.summary by part, written: a row for each part."""
    return written(metrics.summary(t, ["part"]), "measured")


def fold_report(scores: DataFrame) -> DataFrame:
    """part (fold0, ..., oof, mean, sd) and its metrics of out-of-fold scores (row_id, fold, y, p)."""
    scores = written(scores.select("fold", "y", "p"), "scores")  # read once for the folds and once for all
    each = _measured(scores.select(F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("part"), "y", F.col("p").alias("x")))
    whole = _measured(scores.select(F.lit("oof").alias("part"), "y", F.col("p").alias("x")))
    names = [c for c in each.columns if c != "part"]
    over = [each.agg(*(f(c).alias(c) for c in names)).select(F.lit(n).alias("part"), *names) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return each.unionByName(whole).unionByName(over[0]).unionByName(over[1])


def kfold_with_test(df: DataFrame, features: list[str], estimator: Callable[[], Estimator], folds: int = 5, share: float = 0.15, seed: int = DEFAULTS.seed, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores on the rows outside a held-out test part, and a report: folds, out of fold, and the test part under a model refitted on all other rows."""
    t = written(stratified_split(df, {"test": share, "train": 1 - share}, seed).select("row_id", "y", "split", *features), "split")
    rest = t.where("split = 'train'").drop("split")
    scores = out_of_fold(rest, features, estimator, folds, seed, scale)
    model = pipeline(features, estimator(), scale).fit(prepared(rest, features))
    test = scored(model, prepared(t.where("split = 'test'").drop("split"), features))
    return scores, fold_report(scores).unionByName(_measured(test.select(F.lit("test").alias("part"), "y", F.col("p").alias("x"))))


def cosine_warmup(step: Column, total: int, warm: float = 0.06, base: float = 1e-3, least: float = 1e-6) -> Column:
    """The learning rate of a step: a linear warm-up, then half a cosine down to least."""
    first = int(total * warm)
    t = (step - first) / max(1, total - first)
    return F.when(step < first, base * step / max(1, first)).otherwise(least + 0.5 * (base - least) * (1 + F.cos(F.lit(np.pi) * t)))


def train_val_test(df: DataFrame, features: list[str], estimator: Callable[[], Estimator], seed: int = DEFAULTS.seed) -> DataFrame:
    """Metrics on the test part of a model fitted on train and calibrated on val."""
    t = written(prepared(stratified_split(df, seed=seed), features), "split")
    model = pipeline(features, estimator()).fit(t.where("split = 'train'"))
    val, test = scored(model, t.where("split = 'val'")), scored(model, t.where("split = 'test'"))
    return metrics.summary(platt(test, val).withColumnRenamed("calibrated", "x"), [])


def early_stopped_run(df: DataFrame, features: list[str], model: boosting.Parameters | tuple[object, networks.Training], parts: dict[str, float] | None = None, seed: int = DEFAULTS.seed) -> DataFrame:
    """part (val, test, test_calibrated) and its metrics: boosted trees, or a network and how to train it, fitted on train, stopped by val, calibrated on val, and scored on test."""
    t = written(stratified_split(df.select("row_id", "y", *features), parts, seed).withColumn("fold", (F.col("split") == "val").cast("int")), "split")
    seen, test = t.where("split <> 'test'").drop("split"), t.where("split = 'test'").drop("split", "fold")
    if isinstance(model, boosting.Parameters):
        fitted, scores = boosting.fit(seen, features, model, [1])
        tested = boosting.predict(replace(fitted, models=[replace(fitted.models[0], held=None)]), test).select("row_id", "p")
    else:
        net, how = model
        fitted, scores = networks.fit(seen, features, net, how, [1])
        tested = networks.predict(fitted, net, test, features)
    val = scores.where("fold = 1").select("row_id", "y", "p")
    tested = written(test.select("row_id", F.col("y").cast("int").alias("y")).join(tested, "row_id"), "tested")
    calibrated = platt(tested, written(val, "val"))
    out = val.select(F.lit("val").alias("part"), "y", F.col("p").alias("x"))
    for name, scored_rows, column in (("test", tested, "p"), ("test_calibrated", calibrated, "calibrated")):
        out = out.unionByName(scored_rows.select(F.lit(name).alias("part"), "y", F.col(column).alias("x")))
    return _measured(out)
