"""The registered queries of the risk method: each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import coerce
from .functions import patterns as P
from .operators import audit, binning, guard, labels, metrics, neighbours, profile, prune, select, similarity, splits, transform
from .plans import boosting, linear, models, networks
from .scratch import written
from .streaming.windows import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query | None = None, unrounded: tuple[str, ...] = ()) -> Query:
    """Registers f; doubles are rounded to 6 places, for comparison, but for columns that the SQL leaves as they are."""
    if f is None:
        return lambda f: query(f, unrounded)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") and c not in unrounded else F.col(c) for c, t in df.dtypes))

    run.__doc__ = f.__doc__
    QUERIES[f.__name__] = run
    return run


@query
def auc_gini_ks(s, d):
    """AUC, Gini and KS of each document feature against toxicity."""
    t = X.doc_long(s, d)
    return metrics.auc(t, ["feature"]).join(metrics.ks_roc(t, ["feature"]), "feature")


def _scored(s, d):
    return X.doc_scored(s, d).select("row_id", "y", F.col("n_chars").alias("x"))


@query
def decile_table(s, d):
    return metrics.deciles_by_rank(_scored(s, d))


@query
def deciles_v2(s, d):
    return metrics.deciles_by_cut(_scored(s, d))


@query
def average_precision(s, d):
    return metrics.average_precision(X.doc_long(s, d), ["feature"])


@query
def ks_rowwise(s, d):
    return metrics.ks_rowwise(X.doc_long(s, d), ["feature"])


@query
def ks_grid(s, d):
    return metrics.ks_grid(X.doc_long(s, d), ["feature"])


@query
def brier_logloss(s, d):
    return metrics.brier_logloss(_scored(s, d).withColumn("x", F.least(F.col("x") / 20000, F.lit(1.0))), [])


@query
def column_profile(s, d):
    return profile.profile(X.snap_long(s, d))


@query
def fill_rate_filter(s, d):
    return profile.fill_rate_filter(X.snap_long(s, d))


@query(unrounded=("x",))
def value_counts_dominant(s, d):
    return profile.value_counts(X.snap_long(s, d))


@query
def column_filters(s, d):
    return profile.column_filters(profile.profile(X.snap_long(s, d)))


@query
def quality_score(s, d):
    return profile.quality_score(profile.profile(X.snap_long(s, d)))


@query
def event_rates(s, d):
    t = X.snap_long(s, d)
    return profile.event_rates(t, profile.profile(t))


@query
def near_unique(s, d):
    long = profile.to_long(X.table(s, d, "orders").withColumn("big", F.col("o_orderkey") + 20_000_000), ["o_orderkey", "o_custkey", "big"], ())
    names = profile.near_unique_strings(X.table(s, d, "customer"), ["c_name", "c_mktsegment"])
    strict = profile.near_unique(long, strict=True).withColumn("rule", F.lit("strict"))
    return strict.unionByName(profile.near_unique(long).withColumn("rule", F.lit("large"))).unionByName(names.withColumn("rule", F.lit("string")))


@query
def sanity_counts(s, d):
    return profile.sanity(X.snapshot(s, d), X.SNAP_FEATURES)


@query
def histogram(s, d):
    return profile.histogram(X.snap_long(s, d))


@query
def sample_rows(s, d):
    """The sampling operator: a bounded sample is its feature."""
    return profile.sample_rows(X.table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100)


@query
def missingness_auc(s, d):
    return audit.missingness_auc(X.snap_long(s, d))


@query
def column_roles(s, d):
    return P.column_roles(X.column_meta(s, d))


@query
def outcome_score(s, d):
    t = P.text()
    return X.column_meta(s, d).select("column_name", P.outcome_score(t).alias("outcome_score"), P.outcome_type(t).alias("outcome_type"), P.negative_count(t).alias("pattern_count"), P.is_pii_like(F.col("column_name")).alias("is_pii"))


@query
def coerce_values(s, d):
    words = X.table(s, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, ("Yes ", "n", "3", "1", "TRUE", "f"))), (F.col("c_custkey") % 6 + 1).cast("int")).alias("w"), "c_acctbal")
    x = F.col("c_acctbal")
    modes = {m: F.round(coerce.severity(x, m), 6).alias(f"sev_{m}") for m in ("log1p", "asinh", "signed_asinh", "cap", "raw")}
    return words.select("c_custkey", coerce.bool_or_number(F.col("w")).alias("dialect_1"), coerce.bool_few(F.col("w")).alias("dialect_2"), coerce.boolify(F.col("w")).alias("boolified"), *modes.values())


def _events_long(s, d):
    return X.label_events(s, d).select("row_id", F.col("source").alias("feature"), F.col("event").cast("double").alias("x"))


@query
def binary_pairs(s, d):
    """Jaccard, phi and mutual information of every two label sources."""
    return similarity.binary_pairs(_events_long(s, d))


@query
def pearson_pairs(s, d):
    return similarity.pearson(X.snap_long(s, d))


@query
def spearman_pairs(s, d):
    return similarity.spearman(X.snap_long(s, d))


@query
def anova_f(s, d):
    return similarity.anova_f(X.snap_long(s, d), ["feature"])


@query
def mi_binned(s, d):
    return binning.binned_mutual_info(X.doc_long(s, d))


@query
def mi_kbins(s, d):
    return binning.kbins_mutual_info(X.snap_long(s, d), 10)


@query
def woe_table(s, d):
    return binning.woe_smooth(binning.crosstab(binning.qcut(X.doc_long(s, d))))


@query
def iv_qcut(s, d):
    return binning.information_value(binning.woe_smooth(binning.crosstab(binning.qcut(X.doc_long(s, d)))))


@query
def iv_digitize(s, d):
    return binning.information_value(binning.woe_half(binning.crosstab(binning.digitize(X.doc_long(s, d)))))


@query
def woe_categorical(s, d):
    t = X.doc_scored(s, d)
    return binning.categorical_woe(t, "source", 20).unionByName(binning.categorical_woe(t, "lang", 20))


@query
def rare_collapse(s, d):
    return binning.rare_collapse(X.snapshot(s, d), "nation", 60).groupBy("nation").agg(F.count("*").alias("n"))


@query
def label_union(s, d):
    return labels.union_label(X.label_events(s, d))


@query
def label_histogram(s, d):
    return labels.triggered_histogram(X.label_events(s, d))


@query
def label_contribution(s, d):
    return labels.contributions(X.label_events(s, d))


@query
def label_weighted(s, d):
    return labels.weighted_label(X.label_events(s, d), X.source_meta(s), 0.10)


@query
def label_threshold_sweep(s, d):
    return labels.threshold_sweep(labels.weighted_label(X.label_events(s, d), X.source_meta(s), 0.10), [0.5, 0.75, 1.0, 1.25, 1.5])


@query
def label_per_source(s, d):
    return labels.per_source_labels(X.label_events(s, d), X.source_meta(s))


@query
def risk_score(s, d):
    return labels.risk_score(X.label_events(s, d), X.source_meta(s))


@query
def label_clustered(s, d):
    return labels.clustered_label(X.label_events(s, d), X.source_meta(s))


@query
def dominance_prune(s, d):
    return s.createDataFrame([(x,) for x in labels.dominance_prune(X.label_events(s, d), 0.45)], "source string")


@query
def jaccard_dedup(s, d):
    return s.createDataFrame([(x,) for x in labels.jaccard_dedup(X.label_events(s, d), X.source_meta(s), 0.05)], "source string")


TEXTS = {"ret_share": "default share", "urgent_share": "missed dues last 3 month", "acctbal": "balance", "n_events": "declined events", "avg_disc": "over limit lifetime"}


@query
def label_candidates(s, d):
    t = X.snap_long(s, d)
    p = profile.profile(t)
    return labels.candidate_table(p, profile.event_rates(t, p), X.described(s, X.SNAP_FEATURES, TEXTS))


@query
def negative_patterns(s, d):
    return labels.negative_pattern_table(profile.profile(X.snap_long(s, d)), X.described(s, X.SNAP_FEATURES, TEXTS))


@query
def guard_reasons(s, d):
    ext = s.createDataFrame([("paid",), ("ts",)], "column string")
    return guard.snapshot_guard(X.column_meta(s, d), external=ext)


@query
def guard_framework(s, d):
    return guard.framework_guard(X.column_meta(s, d), ["var101022", "spend_a"])


@query
def guard_counts(s, d):
    return guard.reason_counts(guard.snapshot_guard(X.column_meta(s, d)))


@query
def leak_report(s, d):
    t = X.snap_long(s, d)
    y = t.select("row_id", F.lit("y").alias("feature"), F.col("y").cast("double").alias("x")).distinct()
    r = similarity.spearman(t, y).select(F.col("a").alias("feature"), "r")
    return guard.leak_report(X.column_meta(s, d), r, metrics.auc(t, ["feature"]))


@query
def one_hot(s, d):
    return transform.one_hot(X.doc_scored(s, d).select("row_id", "lang"), "lang").drop("lang")


@query
def freq_encode(s, d):
    return transform.frequency(X.doc_scored(s, d).select("row_id", "source"), "source")


@query
def target_encode_cv(s, d):
    t = splits.stratified_folds(X.doc_scored(s, d).select("row_id", "y", "source"))
    return transform.target_encode(t, "source").drop("y")


@query
def impute_scale(s, d):
    return transform.impute_scale(X.snap_long(s, d)).drop("y")


@query
def numeric_transform(s, d):
    kinds = s.createDataFrame([(f, "count" if f.startswith("n_") else "other") for f in X.SNAP_FEATURES], "feature string, kind string")
    return transform.numeric_transform(X.snap_long(s, d), kinds).drop("y")


@query
def standard_scale(s, d):
    return transform.standard_scale(X.snap_long(s, d)).drop("y")


@query
def winsorise(s, d):
    return transform.winsorise(X.snap_long(s, d), 0.01, 0.99).drop("y")


@query
def sanitise(s, d):
    return transform.sanitise(X.snap_long(s, d)).groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


@query
def corr_prune(s, d):
    corr = similarity.pearson(X.snap_long(s, d))
    kept, dropped = prune.prune_inclusive(corr, X.SNAP_FEATURES, 0.8)
    return s.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "feature string, kept boolean")


@query
def leakage_audit(s, d):
    return audit.leakage_audit(X.doc_long(s, d))


@query
def fold_auc(s, d):
    t = X.doc_long(s, d)
    return audit.fold_auc(t, splits.stratified_folds(t.select("row_id", "y").distinct()))


@query
def stratified_split(s, d):
    return splits.stratified_split(X.doc_scored(s, d).select("row_id", "y"))


@query
def stratified_kfold(s, d):
    return splits.stratified_folds(X.doc_scored(s, d).select("row_id", "y"))


@query
def alignment_check(s, d):
    return splits.alignment(X.table(s, d, "customer").select(F.col("c_custkey").alias("row_id")), X.table(s, d, "orders").select(F.col("o_custkey").alias("row_id")).distinct())


def _scores(s, d):
    return select.method_scores(X.snap_long(s, d))


@query
def consensus_rank(s, d):
    return select.consensus_rank(_scores(s, d), ["f", "spearman", "mi"])


@query
def consensus_table(s, d):
    """Scores of several methods side by side, their ranks, and what correlation pruning keeps."""
    t = written(X.snap_long(s, d), "long")
    scores = {
        "mi": binning.kbins_mutual_info(t, 10).select("feature", F.col("mi").alias("score")),
        "iv": binning.information_value(binning.woe_smooth(binning.crosstab(binning.qcut(t)))).select("feature", F.col("iv").alias("score")),
        "missing_auc": select.strip_missing_suffix(audit.missingness_auc(t)).select("feature", F.col("auc").alias("score")),
    }
    kept, _ = prune.prune_inclusive(similarity.pearson(t), X.SNAP_FEATURES, 0.8)
    return select.consensus_table(scores, s.createDataFrame([(c,) for c in kept], "feature string")).drop("stability_rate", "description")


@query
def numeric_kinds(s, d):
    """What kind of number each feature holds, by its words or else by its values."""
    words = s.createDataFrame([("n_orders", "orders made"), ("acctbal", "account balance"), ("ret_share", "returned part")], "feature string, t string")
    return profile.value_kinds(X.snap_long(s, d), words)


@query
def combined_score(s, d):
    return select.combined_score(_scores(s, d))


@query
def event_rate_windows(s, d):
    """Tumbling windows of the events table; the same function serves a stream."""
    return event_windows(X.table(s, d, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


FEATURES = [f for f in X.SNAP_FEATURES if f != "ret_share"]  # the label is made of that one


def _folds(s, d, k=5):
    return written(splits.stratified_folds(X.snapshot(s, d).select("row_id", "y", *FEATURES), k), "snapshot-folds")


@query
def stack_oof(s, d):
    """Out-of-fold scores of boosted trees and of a perceptron, and of a logistic model over both."""
    t = _folds(s, d)
    parts = {"gbt": boosting.cross_validated(t, FEATURES, BOOSTED)[1], "mlp": networks.cross_validated(t, FEATURES, networks.Perceptron(len(FEATURES), (32, 16)), TRAINING)[1]}
    return models.stacked(parts)[0]


#: Boosted trees of the queries: early stopping by the held-out AUC.
BOOSTED = boosting.Parameters(rounds=24, depth=3, rate=0.2, patience=6)


@query
def boosted_cv(s, d):
    """Out-of-fold scores of boosted trees; all folds are grown together and stop by their held-out AUC."""
    return boosting.cross_validated(_folds(s, d), FEATURES, BOOSTED)[1]


@query
def boosted_curves(s, d):
    """The held-out average precision of each fold after each round, and the round that it scores with."""
    return boosting.curves(boosting.cross_validated(_folds(s, d), FEATURES, replace(BOOSTED, metric="ap"))[0], s)


@query
def boosted_importance(s, d):
    """Gains of the splits, averaged over the folds: as shares of mean gains, and summed."""
    model = boosting.cross_validated(_folds(s, d), FEATURES, BOOSTED)[0]
    total = dict(boosting.importance(model, "total"))
    return s.createDataFrame([(f, v, total[f]) for f, v in boosting.importance(model)], "feature string, importance double, total_gain double")


@query
def boosted_rising(s, d):
    """Out-of-fold scores that can only rise with the number of lines and fall with the balance."""
    return boosting.cross_validated(_folds(s, d), FEATURES, replace(BOOSTED, rising={"n_lines": 1, "acctbal": -1}))[1]


#: Small networks for the queries: a few epochs of small blocks.
TRAINING = networks.Training(epochs=8, block=256, rate=0.01, patience=3)


@query
def perceptron_cv(s, d):
    """Out-of-fold scores of a perceptron trained by mini-batches, with the held-out AUC deciding the epoch."""
    return networks.cross_validated(_folds(s, d), FEATURES, networks.Perceptron(len(FEATURES), (32, 16)), TRAINING)[1]


@query
def attention_cv(s, d):
    """Out-of-fold scores of attention over features, trained likewise."""
    return networks.cross_validated(_folds(s, d), FEATURES, networks.Attention(len(FEATURES), width=8, layers=1, heads=2), TRAINING)[1]


@query
def tvt_report(s, d):
    """A perceptron fitted on train, stopped and calibrated by val, and scored on test."""
    return models.early_stopped_run(X.snapshot(s, d), FEATURES, (networks.Perceptron(len(FEATURES), (32, 16)), TRAINING))


@query
def split_gains(s, d):
    """The best first split of each feature, by the gain in log loss."""
    return boosting.split_gains(X.snapshot(s, d), FEATURES)


@query
def mi_knn(s, d):
    """Mutual information of each feature and the label, by distances to the third neighbour of the same class."""
    return neighbours.mi_knn(X.snap_long(s, d))


#: A fixed score of whole numbers, so that sums are exact.
WEIGHTS = {"acctbal": -1, "n_orders": 300, "avg_price": 2, "n_lines": 100, "avg_qty": 50, "n_events": -10}


@query
def permuted_auc(s, d):
    """AUC of a fixed score when the values of a feature trade places, twice for each feature."""
    weights = np.array([WEIGHTS[f] for f in WEIGHTS], np.float64)
    return models.permuted_auc(X.snapshot(s, d), [*WEIGHTS], lambda x: np.floor(np.nan_to_num(x)) @ weights, 2)


@query
def fold_metrics(s, d):
    """The report by fold, over all rows, and their mean and deviation, of a fixed score."""
    t = splits.stratified_folds(X.doc_scored(s, d), 5).withColumn("p", F.least(F.col("n_chars") / 20000, F.lit(1.0)))
    return models.fold_report(t.select("row_id", "fold", "y", "p"))


@query
def platt(s, d):
    return models.platt(models.out_of_fold(X.snapshot(s, d), FEATURES, models.logistic))


@query
def stability_pcs(s, d):
    """How often each feature is among the four that L1 models and boosted trees rank first, over five seeds."""
    return select.stability(models.stability_runs(X.snapshot(s, d), FEATURES, top=4), 5)


@query
def pcs_protocol(s, d):
    """An elastic net and boosted trees under five seeds of five folds: AUC, AP and how far the seeds' top features agree."""
    return models.repeated_protocol(X.snapshot(s, d), FEATURES, top=4, p=boosting.Parameters(rounds=12, rate=0.2))


@query
def elastic_net_cv(s, d):
    """Out-of-fold scores of an elastic net, all folds fitted in the same passes."""
    return linear.fit(_folds(s, d), FEATURES, held=[("fold", k) for k in range(5)])[1].select(F.col("model").alias("fold"), "row_id", "y", "p")


@query
def l1_importance(s, d):
    """Importances, and the AUC of the model on a holdout."""
    t, auc = models.l1_importance(X.snapshot(s, d), FEATURES)
    return t.withColumn("auc", F.lit(auc))


@query
def permutation_importance(s, d):
    return models.permutation_importance(X.snapshot(s, d), FEATURES)


@query
def model_search(s, d):
    """Random search over boosted trees, by out-of-fold metrics: all folds of four trials grow together."""
    return models.search(X.snapshot(s, d), FEATURES, trials=4, rounds=(6, 12), patience=4)


@query
def fold_report(s, d):
    """Metrics of a logistic model by fold, over all folds, and on held-out rows."""
    return models.kfold_with_test(X.snapshot(s, d), FEATURES, models.logistic)[1]


@query
def boosted_report(s, d):
    """Metrics of boosted trees by fold, over all folds, and their mean and deviation."""
    return models.fold_report(boosting.cross_validated(_folds(s, d), FEATURES, BOOSTED)[1])


@query
def baseline_check(s, d):
    return models.baseline_check(X.snapshot(s, d), FEATURES)


def _candidates(s, d):
    t = X.snap_long(s, d)
    p = profile.profile(t).persist()
    words = X.described(s, X.SNAP_FEATURES, TEXTS)
    return labels.candidate_table(p, profile.event_rates(t, p), words), labels.negative_pattern_table(p, words)


def _sources(s, d, **how):
    candidates, negative = _candidates(s, d)
    return labels.assemble_sources(negative, candidates, **how)


@query
def label_sources(s, d):
    """Sources of labels: recommended ones first, then other eligible ones, without lifetime windows."""
    return _sources(s, d)


@query
def label_sources_compat(s, d):
    return _sources(s, d, compat_suffix_loss=True)


@query
def label_sources_table(s, d):
    return labels.sources_table(_sources(s, d), s.createDataFrame([(n, TEXTS.get(n, "")) for n in X.SNAP_FEATURES], "column_name string, description string"))


@query
def label_rescue(s, d):
    return labels.rescue_candidates(_candidates(s, d)[0])


@query
def binarised_sources(s, d):
    """What each source fires on: at or above a positive threshold, else above 0."""
    return labels.binarise(X.snap_long(s, d), _sources(s, d)).groupBy("source").agg(F.sum("event").alias("n_events"), F.sum("severity").alias("severity"))


@query
def severe_sources(s, d):
    """The sources of at least some weight (all if none has it), and how many events each has."""
    chosen = s.createDataFrame([(least, x) for least in (0.7, 2.0) for x in labels.severe_sources(X.source_meta(s), least)], "least double, source string")
    n = X.label_events(s, d).groupBy("source").agg(F.sum("event").alias("n_events"))
    return chosen.join(n, "source").select("least", "source", "n_events")


@query
def severity_auto(s, d):
    """Severities whose form depends on the column's range."""
    t = X.snap_long(s, d)
    ends = t.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return t.join(F.broadcast(ends), "feature").select("row_id", "feature", coerce.severity(F.col("x"), "auto", least=F.col("lo"), most=F.col("hi")).alias("severity"))


@query
def top_dummies(s, d):
    """How often each dummy of the three most frequent sources is set."""
    t = transform.top_dummies(X.doc_scored(s, d).select("source"), "source", 3).drop("source")
    return t.unpivot([], t.columns, "dummy", "hit").groupBy("dummy").agg(F.sum("hit").alias("n"))


@query
def fill_zero(s, d):
    return transform.fill_zero(X.snap_long(s, d)).drop("y")


def _pruned(s, kept, dropped):
    return s.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "feature string, kept boolean")


def _priority(s, d):
    return {r["feature"]: r["n"] / 1e6 for r in X.snap_long(s, d).groupBy("feature").agg(F.count("x").alias("n")).collect()}


@query
def corr_prune_strict(s, d):
    """Pairs above 0.8: the column with fewer values goes, of equals the earlier."""
    return _pruned(s, *prune.prune_correlated(similarity.pearson(X.snap_long(s, d)), X.SNAP_FEATURES, 0.8, _priority(s, d)))


@query
def redundant_columns(s, d):
    """Columns whose ranks follow an earlier column's (strictly above), and whose values do (at or above)."""
    t = X.snap_long(s, d)
    strict = [("spearman", c) for c in prune.redundant(similarity.spearman(t), X.SNAP_FEATURES, 0.8)]
    return s.createDataFrame(strict + [("pearson", c) for c in prune.redundant(similarity.pearson(t), X.SNAP_FEATURES, 0.8, inclusive=True)], "rule string, feature string")


@query
def component_prune(s, d):
    """Of each group of columns that correlate, the one with most values stays."""
    return _pruned(s, *prune.prune_components(similarity.pearson(X.snap_long(s, d)), X.SNAP_FEATURES, _priority(s, d), 0.8))


@query
def auto_guard(s, d):
    return guard.auto_guard(X.column_meta(s, d), ["flag", "default", "bad"])


@query
def verification_guard(s, d):
    return guard.verification_guard(X.column_meta(s, d), ["var207028", "spend_a"])


@query
def guard_from_files(s, d):
    """A guard from lines of name or name,reason, and from buckets of names."""
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat("p_name", F.lit(","), "p_type")).when(kind == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(kind == 2, "").otherwise("variable,reason")
    lines = X.table(s, d, "part").select(line.alias("value"))
    buckets = X.table(s, d, "events").groupBy(F.hour("ts").alias("h")).agg(F.collect_set("event_type").alias("ids")).select("ids", F.array(F.concat(F.lit("hour_"), F.col("h").cast("string"))).alias("outcome"), F.lit(None).cast("array<string>").alias("other"))
    return guard.guard_from_lines(lines, guard.guard_from_buckets(buckets))


@query
def forbidden_window_columns(s, d):
    """Columns whose window is that of a source in use, and whether a feature may use them."""
    meta = X.column_meta(s, d)
    windows = guard.forbidden_windows(meta, ["spend_a", "var207028"])
    return meta.select("column_name", P.is_time_safe(P.text(), windows).alias("safe"))


@query
def auc_bands(s, d):
    t = metrics.auc(X.snap_long(s, d), ["feature"])
    return t.select("feature", guard.auc_band(F.col("auc")).alias("band")).join(guard.too_predictive(t, 0.6).select(F.col("column").alias("feature"), F.lit(True).alias("too_predictive")), "feature", "left")


@query
def single_feature_scan(s, d):
    return select.single_feature_scan(X.doc_long(s, d))


@query
def per_label_scores(s, d):
    """Scores of every feature for two labels at once; a third without a positive row is left out."""
    t = X.snapshot(s, d).select("row_id", F.col("y").alias("returns"), (F.col("acctbal") < 0).cast("int").alias("negative"), F.lit(0).alias("never"), F.lit(2).alias("other"))
    return select.label_scores(X.snap_long(s, d), t.unpivot(["row_id"], ["returns", "negative", "never", "other"], "label", "y"))


@query
def importance_matrix(s, d):
    t = _scores(s, d)
    return select.importance_matrix({c: t.where(F.col(c) > 0.01).select("feature", F.col(c).alias("score")) for c in ("spearman", "mi")})


@query
def top_features(s, d):
    """A top-k report: the three features of the largest mutual information."""
    return profile.top_k(_scores(s, d).select("feature", "mi"), "mi", "feature", 3)


@query
def bar_chart(s, d):
    return profile.bar_table(_scores(s, d), "feature", "spearman")


@query
def heat_map(s, d):
    return profile.heatmap_table(similarity.binary_pairs(_events_long(s, d)), "jaccard", [n for n, _, _ in X.SOURCES])


@query
def missing_flag_names(s, d):
    return select.strip_missing_suffix(audit.missingness_auc(X.snap_long(s, d)))


@query
def holdout_split(s, d):
    return splits.holdout(X.doc_scored(s, d).select("row_id", "y"))


@query
def metric_summary(s, d):
    t = _scored(s, d).withColumn("x", F.least(F.col("x") / 20000, F.lit(1.0))).select(F.lit("all").alias("part"), "y", "x")
    return metrics.summary(t, ["part"])


@query
def strict_label(s, d):
    t = profile.to_long(X.snapshot(s, d).withColumns({"default_hi": (F.col("ret_share") > 0.5).cast("int"), "overdue_hi": (F.col("avg_disc") > 0.053).cast("int"), "late_hi": (F.col("acctbal") < 0).cast("int")}), ["default_hi", "overdue_hi", "late_hi", "acctbal"])
    meta = X.described(s, ["default_hi", "overdue_hi", "late_hi", "acctbal"], {"default_hi": "default flag", "overdue_hi": "overdue flag", "late_hi": "late flag"})
    return select.strict_label(profile.profile(t), meta)


@query
def set_stability(s, d):
    """How alike the choices of three runs are: the features that fill best in thirds of the rows."""
    t = X.snap_long(s, d).withColumn("run", (F.col("row_id") % 3).cast("int"))
    n = t.groupBy("run", "feature").agg(F.sum("x").alias("total"))
    chosen = n.where("total > 12000").select(F.lit("L1").alias("method"), "run", "feature")
    return select.set_stability(chosen)


@query
def dtype_split(s, d):
    t = X.snapshot(s, d)
    numeric, rest = profile.by_type(t, t.columns)
    return s.createDataFrame([(c, True) for c in numeric] + [(c, False) for c in rest], "column string, is_numeric boolean")


@query
def truncated_names(s, d):
    return profile.truncated(X.table(s, d, "part").select("p_partkey", "p_name"), "p_name", 12)


@query
def encoded_categories(s, d):
    """A category of few levels becomes dummies, one of many its levels' shares."""
    t, names = transform.encoded_categories(X.snapshot(s, d).select("row_id", "segment", "nation"), ["segment", "nation"])
    return t.select("row_id", *(F.col(c).cast("double").alias(c) for c in names))


@query
def warmup_schedule(s, d):
    """The learning rate of each event's turn, were each event a step."""
    events = X.table(s, d, "events")
    return events.select(F.col("event_id").alias("step"), F.round(models.cosine_warmup(F.col("event_id"), events.count()) * 1000, 6).alias("rate"))
