"""The three entries of the method as functions over one wide table: label discovery, feature engineering, training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import patterns as P
from ..operators import audit, guard, labels, metrics, profile, prune, similarity, splits, transform
from ..scratch import dropped, written
from . import boosting, models, networks


@dataclass
class Discovery:
    candidates: DataFrame
    negative: DataFrame
    events: DataFrame | None
    labels: DataFrame | None
    sources: list[str]
    status: str


def discover_labels(df: DataFrame, columns: list[str], meta: DataFrame, s: Settings = DEFAULTS, compat: bool = False) -> Discovery:
    """Entry A: finds outcome-like columns of df (row_id, columns), makes sources of them, and composes labels and a risk score.

    meta: column_name, description. Without an eligible source the status is failed and there are no labels.
    """
    long = written(profile.to_long(df, columns), "long")
    prof = written(profile.profile(long), "profile")
    words = meta.select(F.col("column_name").alias("variable"), P.text().alias("text"))
    candidates = written(labels.candidate_table(prof, profile.event_rates(long, prof, s.event_quantile), words, s), "candidates")
    negative = written(labels.negative_pattern_table(prof, words, s), "negative")
    sources = written(labels.assemble_sources(negative, candidates, s, compat), "sources")
    events = written(labels.binarise(long, sources), "events")
    live = [r[0] for r in events.select("source").distinct().collect()]
    if not live:
        return Discovery(candidates, negative, None, None, [], "failed")
    weights = sources.where(F.col("source").isin(live)).select("source", "weight", "window")
    kept = labels.jaccard_dedup(events, weights, s.dedup_jaccard)
    kept = labels.dominance_prune(events.where(F.col("source").isin(kept)), s.dominance, s.dominance_floor)
    events, weights = events.where(F.col("source").isin(kept)), written(weights.where(F.col("source").isin(kept)), "weights")
    union = written(labels.union_label(events), "union")
    prevalence = union.agg(F.avg("label_union")).first()[0]
    parts = [written(t, "label") for t in (labels.weighted_label(events, weights, prevalence), labels.clustered_label(events, weights), labels.risk_score(events, weights, s))]
    out = union.join(parts[0], "row_id").join(parts[1], "row_id").join(parts[2], "row_id")
    return Discovery(candidates, negative, events, out.withColumn("label_hierarchical", F.col("label_union")), kept, "ok")


@dataclass
class Features:
    matrix: DataFrame
    columns: list[str]
    guard: DataFrame
    dropped: list[str]
    audit: DataFrame


def engineer_features(df: DataFrame, columns: list[str], meta: DataFrame, y: str = "y", sources: DataFrame | None = None, s: Settings = DEFAULTS, categories: list[str] | None = None) -> Features:
    """Entry B: guard, fill rate, transform, impute, scale, prune, audit. df: row_id, y, columns. The matrix has a column of single precision for each feature kept.

    Columns that hold no numbers (categories, if given) become a 0/1 feature for each of few levels, else the level's share.
    """
    numeric, rest = profile.by_type(df, columns)
    categories = rest if categories is None else categories
    columns = [c for c in columns if c in numeric and c not in categories]
    long = profile.to_long(df.withColumnRenamed(y, "y") if y != "y" else df, columns, ("row_id", "y"))
    long = written(long, "long")
    unique = profile.near_unique(long, s.near_unique).select(F.col("feature").alias("column"))
    banned = written(guard.snapshot_guard(meta.where(F.col("column_name").isin(columns)), sources=sources, near_unique=unique), "guard")
    kept = guard.keep_ordinals(columns, banned)
    filled = {r["feature"] for r in profile.fill_rate_filter(long.where(F.col("feature").isin(kept)), s.fill_rate).collect()}
    kept = [c for c in kept if c in filled]
    texts = {r["column_name"]: r["t"] for r in meta.select("column_name", P.text().alias("t")).collect()}
    words = df.sparkSession.createDataFrame([(c, texts.get(c, c)) for c in kept], "feature string, t string")
    kinds = profile.value_kinds(long.where(F.col("feature").isin(kept)), words).select("feature", "kind")
    # Each step is written, as the next one reads it several times.
    scaled = written(transform.impute_scale(transform.numeric_transform(long.where(F.col("feature").isin(kept)), written(kinds, "kinds"))), "scaled")
    encoded, names = transform.encoded_categories(df.withColumnRenamed(y, "y") if y != "y" else df, guard.keep_ordinals(categories, guard.snapshot_guard(meta.where(F.col("column_name").isin(categories)), sources=sources)) if categories else [], s.one_hot_levels)
    if names:
        scaled = written(scaled.unionByName(profile.to_long(encoded, names, ("row_id", "y")).select(*scaled.columns)), "encoded")
    kept = [*kept, *names]
    clean = written(transform.sanitise(scaled, s.least_std), "clean")
    live = [c for c in kept if c in {r[0] for r in clean.select("feature").distinct().collect()}]
    priority = {r["feature"]: abs(r["auc"] - 0.5) for r in metrics.auc(clean, ["feature"]).collect()}
    chosen, dropped = prune.prune_inclusive(similarity.pearson(clean), live, s.correlation_inclusive, priority)
    chosen = [c for c in live if c in set(chosen)]
    report = audit.leakage_audit(clean.where(F.col("feature").isin(chosen)), s)
    return Features(transform.to_wide(clean, chosen, ("row_id", "y")), chosen, banned, sorted({*columns} - {*chosen} | {*dropped}), report)


def train(matrix: DataFrame, features: list[str], folds: int = 5, s: Settings = DEFAULTS, nested: bool = False, trees: boosting.Parameters | None = None, net: networks.Perceptron | None = None, t: networks.Training | None = None) -> dict[str, DataFrame]:
    """Entry C: out-of-fold trees and perceptron, a stack of both, calibration, metrics and deciles. trees: as a search found them, say; a stack uses them without class weight and early stop."""
    rows = written(splits.stratified_folds(matrix.select("row_id", "y", *features), folds, s.seed), "folds")
    parts = {
        "gbt": boosting.cross_validated(rows, features, models.for_stacking(trees), folds)[1],
        "mlp": networks.cross_validated(rows, features, net or networks.Perceptron(len(features), (128, 64), 0.0), t or networks.Training(epochs=30, block=256, seed=s.seed), folds)[1],
    }
    stack, _, _ = models.stacked(parts, nested, folds, s.seed)
    score = written(stack.select("row_id", "y", F.col("oof_stack").alias("p")), "stack-scores")
    x = written(models.platt(score).select("row_id", "y", F.col("calibrated").alias("x")), "calibrated")
    dropped(rows)
    return {"oof": stack, "calibrated": x, "metrics": metrics.summary(x, []), "deciles": metrics.deciles_by_rank(x, s.bins), "deciles_by_cut": metrics.deciles_by_cut(x, s.bins)}
