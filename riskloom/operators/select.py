"""Feature selection: scores of several methods, their combination, stability and consensus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..scratch import written
from . import metrics
from .binning import kbins_mutual_info
from .similarity import anova_f, spearman
from .splits import holdout

#: The weights of the methods in the combined score.
WEIGHTS = {"mi": 0.30, "f": 0.25, "spearman": 0.25, "l1": 0.20}


def combined_score(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """feature, score of scores (feature and a column for each method): each over its maximum, weighted, summed."""
    weights = weights or WEIGHTS
    used = [c for c in weights if c in scores.columns]
    top = scores.agg(*(F.max(F.abs(c)).alias(f"_m_{c}") for c in used))
    part = lambda c: F.coalesce(F.when(F.col(f"_m_{c}") > 0, F.abs(c) / F.when(F.col(f"_m_{c}") > 0, F.col(f"_m_{c}"))), F.lit(0.0)) * weights[c]
    return scores.crossJoin(F.broadcast(top)).select("feature", reduce(lambda a, b: a + b, map(part, used), F.lit(0.0)).alias("score"))


def method_scores(long: DataFrame, bins: int = DEFAULTS.bins) -> DataFrame:
    """feature, f, spearman (absolute) and mi of long (row_id, y, feature, x), to 9 places, so that equal features tie."""
    long = long.persist()  # every method reads it
    y = long.select("row_id", F.lit("y").alias("feature"), F.col("y").cast("double").alias("x")).distinct()
    r = spearman(long, y).select(F.col("a").alias("feature"), F.abs("r").alias("spearman"))
    t = anova_f(long, ["feature"]).join(r, "feature", "left").join(kbins_mutual_info(long, bins), "feature", "left")
    return t.select("feature", *(F.round(c, 9).alias(c) for c in ("f", "spearman", "mi")))


def label_scores(long: DataFrame, labels: DataFrame) -> DataFrame:
    """label, feature, f, spearman, mi and score for each label at once. long: row_id, feature, x; labels: row_id, label, y.

    Labels with other values than 0 and 1, or without a positive row, are left out.
    """
    fit = labels.groupBy("label").agg(F.max((~F.coalesce(F.col("y").isin(0, 1), F.lit(True))).cast("int")).alias("other"), F.sum("y").alias("n")).where("other = 0 and n > 0").select("label")
    t = long.select("row_id", "feature", "x").join(labels.join(F.broadcast(fit), "label", "left_semi").where("y is not null"), "row_id")
    both = written(method_scores_by(t), "label-scores")  # a row for each label and feature
    top = both.groupBy("label").agg(*(F.max(F.abs(c)).alias(f"_m_{c}") for c in ("f", "spearman", "mi")))
    part = lambda c: F.coalesce(F.when(F.col(f"_m_{c}") > 0, F.abs(c) / F.when(F.col(f"_m_{c}") > 0, F.col(f"_m_{c}"))), F.lit(0.0)) * WEIGHTS[c]
    return both.join(F.broadcast(top), "label").select("label", "feature", "f", "spearman", "mi", (part("mi") + part("f") + part("spearman")).alias("score"))


def method_scores_by(t: DataFrame) -> DataFrame:
    """label, feature, f, spearman, mi of t (row_id, label, y, feature, x).

    t and what each method finds are written, so that the driver never holds the plans of all of them in one.
    """
    t = written(t, "labelled")  # every method reads it
    named = t.select("row_id", "y", F.to_json(F.array("label", "feature")).alias("feature"), "x")
    scores = anova_f(named, ["feature"]).join(kbins_mutual_info(named, DEFAULTS.bins), "feature", "left")
    name = F.from_json("feature", "array<string>")
    scores = written(scores.select(name[0].alias("label"), name[1].alias("feature"), "f", "mi"), "scores")
    y = t.select("row_id", F.col("label").alias("feature"), F.col("y").cast("double").alias("x")).distinct()
    r = written(spearman(t.select("row_id", "feature", "x").distinct(), y).select(F.col("a").alias("feature"), F.col("b").alias("label"), F.abs("r").alias("spearman")), "ranks")
    return scores.join(r, ["label", "feature"], "left").select("label", "feature", *(F.round(c, 9).alias(c) for c in ("f", "spearman", "mi")))


def single_feature_scan(long: DataFrame, share: float = 0.25, seed: int = DEFAULTS.seed) -> DataFrame:
    """feature, single_feature_auc on a stratified holdout: a model of one feature is monotone, so its AUC is the feature's own, either way round."""
    test = holdout(long.select("row_id", "y").distinct(), share, seed).where("split = 'test'").select("row_id")
    return metrics.auc(long.join(test, "row_id", "left_semi"), ["feature"]).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("single_feature_auc"))


def importance_matrix(tables: dict[str, DataFrame]) -> DataFrame:
    """feature, a column for each label's score (0 where it has none), and their mean. tables: label -> (feature, score)."""
    out = reduce(lambda a, b: a.join(b, "feature", "full"), (t.select("feature", F.col("score").alias(n)) for n, t in tables.items()))
    out = out.select("feature", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in tables))
    return out.withColumn("mean_score", sum((F.col(n) for n in tables), F.lit(0.0)) / len(tables))


def consensus_rank(scores: DataFrame, columns: list[str]) -> DataFrame:
    """scores with rank_<column> (1 the best, ties averaged, missing as 0) and consensus_rank, their mean."""
    out = scores.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2  # noqa: E731  a row for each feature: few
    out = out.withColumns({f"rank_{c}": rank(c) for c in columns})
    return out.withColumn("consensus_rank", sum((F.col(f"rank_{c}") for c in columns), F.lit(0.0)) / len(columns))


def consensus_table(scores: dict[str, DataFrame], kept: DataFrame | None = None, stability_rates: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """variable, a column for each score (null where a method has none), rank_<score>, consensus_rank, kept_after_prune, stability_rate and description, best rank first.

    scores: name -> (feature, score). kept: feature, of those that pruning leaves; stability_rates: feature, stability_rate; words: variable,
    description. Missing scores count as 0 in ranks. A variable that any table names has a row.
    """
    out = reduce(lambda a, b: a.join(b, "feature", "full"), (t.select("feature", F.col("score").alias(n)) for n, t in scores.items()))
    out = written(out, "scores")  # a row a feature
    ranks = consensus_rank(out, list(scores)).select("feature", *(f"rank_{n}" for n in scores), "consensus_rank")
    out = out.join(ranks, "feature")
    keep = kept.select("feature").distinct().withColumn("kept_after_prune", F.lit(1)) if kept is not None else None
    out = out.join(keep, "feature", "left").withColumn("kept_after_prune", F.coalesce("kept_after_prune", F.lit(0))) if keep is not None else out.withColumn("kept_after_prune", F.lit(None).cast("int"))
    out = out.join(stability_rates.select("feature", "stability_rate"), "feature", "left") if stability_rates is not None else out.withColumn("stability_rate", F.lit(None).cast("double"))
    out = out.withColumnRenamed("feature", "variable")
    out = out.join(words.select("variable", "description"), "variable", "left") if words is not None else out.withColumn("description", F.lit(None).cast("string"))
    return out.orderBy("consensus_rank", F.desc_nulls_last("stability_rate"), "variable")  # a row a feature


def strip_missing_suffix(df: DataFrame, column: str = "feature") -> DataFrame:
    """Scores of missing-value flags under their column's own name."""
    return df.withColumn(column, F.regexp_replace(column, "__isna$", ""))


def stability(selected: DataFrame, runs: int) -> DataFrame:
    """feature, a rate for each method, and their mean. selected: method, run, feature of what each run chose."""
    t = selected.groupBy("feature").pivot("method", ["L1", "TREE"]).agg(F.count_distinct("run")).na.fill(0)
    return t.select("feature", (F.col("L1") / runs).alias("rate_l1"), (F.col("TREE") / runs).alias("rate_tree"), ((F.col("L1") + F.col("TREE")) / (2 * runs)).alias("stability_rate"))


def set_stability(selected: DataFrame) -> DataFrame:
    """method, jaccard: the mean Jaccard of every two runs' choices."""
    sets = selected.groupBy("method", "run").agg(F.collect_set("feature").alias("s"))
    a, b = sets.alias("a"), sets.alias("b")
    j = F.size(F.array_intersect("a.s", "b.s")) / F.size(F.array_union("a.s", "b.s"))
    return a.join(b, (F.col("a.method") == F.col("b.method")) & (F.col("a.run") < F.col("b.run"))).groupBy("a.method").agg(F.avg(j).alias("jaccard"))


def strict_label(prof: DataFrame, meta: DataFrame, low: float = 0.005, high: float = 0.40) -> DataFrame:
    """The one boolean feature that a strict reading of names takes as the label: keyword, no excluded word, prevalence in range; the rarest first by name on ties."""
    from ..functions import patterns as P

    t = prof.withColumnRenamed("feature", "variable").join(F.broadcast(meta), "variable")
    ok = F.col("is_binary") & F.col("mean").between(low, high) & P.is_strict_label(F.col("text"))
    return t.where(ok).orderBy("mean", "variable").limit(1).select("variable", F.col("mean").alias("positive_rate"))
