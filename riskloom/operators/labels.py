"""Label composition: sources become 0/1 events and severities; labels and a risk score come from them.

events: row_id, source, event, severity (a row for each row and source). meta: source, weight, window.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.coerce import severity
from ..scratch import written
from .order import average_ranks, exact_quantiles
from .similarity import binary_pairs


def assemble_sources(recommended: DataFrame, candidates: DataFrame, s: Settings = DEFAULTS, compat_suffix_loss: bool = False) -> DataFrame:
    """source, weight, window, event_threshold: recommended sources first, then other eligible ones.

    compat_suffix_loss: thresholds of all are lost as soon as there is a recommended source, as a known fault had it.
    """
    first = recommended.where("recommended_for_label").select(F.col("variable").alias("source"), F.col("priority_score").alias("weight"), F.lit(True).alias("first"))
    rest = candidates.where("eligible_for_label").join(first.select(F.col("source").alias("variable")), "variable", "left_anti")
    rest = rest.select(F.col("variable").alias("source"), F.col("combined_score").alias("weight"), F.lit(False).alias("first"))
    out = first.unionByName(rest).join(candidates.select(F.col("variable").alias("source"), "window", "event_threshold"), "source", "left")
    if compat_suffix_loss and first.limit(1).collect():
        out = out.withColumn("event_threshold", F.lit(None).cast("double"))
    return out.where(F.coalesce("window", F.lit("unknown")) != "lt")


def binarise(long: DataFrame, sources: DataFrame, mode: str = "log1p") -> DataFrame:
    """events of long (row_id, feature, x): at or above a positive threshold, else above 0; sources without any event go."""
    t = long.join(F.broadcast(sources.select(F.col("source").alias("feature"), "event_threshold")), "feature")
    hit = F.when(F.col("event_threshold") > 0, F.col("x") >= F.col("event_threshold")).otherwise(F.col("x") > 0)
    t = t.select("row_id", F.col("feature").alias("source"), F.coalesce(hit, F.lit(False)).cast("int").alias("event"), severity(F.col("x"), mode).alias("severity"))
    live = t.groupBy("source").agg(F.max("event").alias("m")).where("m > 0").select("source")
    return t.join(F.broadcast(live), "source", "left_semi")


def sources_table(sources: DataFrame, meta: DataFrame) -> DataFrame:
    """label_source, weight, desc, event_threshold, window of the sources, the heaviest first. meta: column_name, description."""
    t = sources.join(F.broadcast(meta.select(F.col("column_name").alias("source"), F.col("description").alias("desc"))), "source", "left")
    return t.select(F.col("source").alias("label_source"), "weight", "desc", "event_threshold", "window").orderBy(F.desc("weight"), "label_source")


def rescue_candidates(candidates: DataFrame, prevalence: tuple[float, float] = (0.002, 0.40), k: int = 12) -> DataFrame:
    """The k best of the candidates that are not eligible but for relaxed limits: any outcome score, and a prevalence within these."""
    rest = candidates.where(~F.col("eligible_for_label") & (F.col("outcome_score") > 0) & F.col("event_positive_rate").between(*prevalence))
    return rest.orderBy(F.desc("combined_score"), "variable").limit(k)


def union_label(events: DataFrame) -> DataFrame:
    """row_id, label_union, n_sources, first_source: whether any source fires, how many, and the first by name."""
    return events.groupBy("row_id").agg(F.max("event").alias("label_union"), F.sum("event").alias("n_sources"), F.min(F.when(F.col("event") == 1, F.col("source"))).alias("first_source"))


def triggered_histogram(events: DataFrame) -> DataFrame:
    return union_label(events).groupBy("n_sources").agg(F.count("*").alias("n_rows"))


def contributions(events: DataFrame) -> DataFrame:
    """source, share: of the rows with any event, how many have the source's; and its share of all rows."""
    label = union_label(events).where("label_union = 1").select("row_id")
    inside = events.join(label, "row_id", "left_semi").groupBy("source").agg(F.avg("event").alias("share"))
    return inside.join(events.groupBy("source").agg(F.avg("event").alias("prevalence")), "source")


def jaccard_dedup(events: DataFrame, meta: DataFrame, least: float = DEFAULTS.dedup_jaccard) -> list[str]:
    """Sources kept, greedily by falling weight (then name): each is under the Jaccard threshold with all kept before. Only edges of source pairs come to the driver."""
    edges = binary_pairs(events.select("row_id", F.col("source").alias("feature"), F.col("event").cast("double").alias("x"))).where(F.col("jaccard") >= least)
    close: dict[str, set[str]] = {}
    for r in edges.select("a", "b").collect():
        close.setdefault(r["a"], set()).add(r["b"])
        close.setdefault(r["b"], set()).add(r["a"])
    kept: list[str] = []
    for r in meta.select("source", "weight").orderBy(F.desc("weight"), "source").collect():
        if close.get(r["source"], set()).isdisjoint(kept):
            kept.append(r["source"])
    return kept


def dominance_prune(events: DataFrame, cutoff: float = DEFAULTS.dominance, floor: float = DEFAULTS.dominance_floor) -> list[str]:
    """Sources left after those with a share of at least cutoff go, as long as the rest keeps the union's prevalence at floor."""
    sources = sorted(r["source"] for r in events.select("source").distinct().collect())
    while True:
        now = events.where(F.col("source").isin(sources))
        heavy = {r["source"] for r in contributions(now).where(F.col("share") >= cutoff).collect()}
        rest = [s for s in sources if s not in heavy]
        if not heavy or not rest:
            return sources
        left = union_label(events.where(F.col("source").isin(rest))).agg(F.avg("label_union")).first()[0]
        if left < floor:
            return sources
        sources = rest


def severe_sources(meta: DataFrame, least: float = DEFAULTS.severe_weight) -> list[str]:
    """Sources of at least this weight; all if there are none."""
    rows = meta.select("source", "weight").orderBy("source").collect()
    return [r["source"] for r in rows if r["weight"] >= least] or [r["source"] for r in rows]


def weighted_label(events: DataFrame, meta: DataFrame, prevalence: float) -> DataFrame:
    """row_id, wscore, label_weighted: positive scores at or above their quantile 1 - prevalence (within 0.005 and 0.5)."""
    score = events.join(F.broadcast(meta.select("source", "weight")), "source").groupBy("row_id").agg(F.sum(F.col("severity") * F.col("weight") * F.col("event")).alias("wscore"))
    cut = exact_quantiles(score.where("wscore > 0"), [], "wscore", [1 - min(max(prevalence, 0.005), 0.5)])
    return score.crossJoin(F.broadcast(cut)).select("row_id", "wscore", F.coalesce((F.col("wscore") > 0) & (F.col("wscore") >= F.col("q0")), F.lit(False)).cast("int").alias("label_weighted"))


def column_clusters(names: list[str], vectors: np.ndarray, k: int, first: str, rounds: int = 10) -> dict[str, int]:
    """The cluster of each name by k-means over its vector (columns by columns: few), the same for any order of the names.

    It begins with `first` and goes on with the name farthest from what is chosen; ties go to the name that sorts first, to the earlier cluster, and a cluster
    without members keeps its centre.
    """
    order = sorted(range(len(names)), key=lambda i: names[i])
    names, vectors = [names[i] for i in order], np.round(vectors[np.ix_(order, order)], 9)
    centres = [vectors[names.index(first)]]
    away = lambda: np.round(((vectors[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2), 9)
    while len(centres) < min(k, len(names)):
        centres.append(vectors[int(np.argmax(away().min(axis=1)))])
    for _ in range(rounds):
        own = away().argmin(axis=1)
        centres = [vectors[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]
    return dict(zip(names, away().argmin(axis=1).tolist()))


def clustered_label(events: DataFrame, meta: DataFrame, rounds: int = 10) -> DataFrame:
    """row_id, label_clustered: sources are clustered on their absolute correlations; the heaviest of each cluster (the first by name on ties) makes the union. Under three sources: all."""
    from .similarity import pearson

    names = sorted(r["source"] for r in events.select("source").distinct().collect())
    reps = names
    if len(names) >= 3:
        long = events.select("row_id", F.col("source").alias("feature"), F.col("event").cast("double").alias("x"))
        r = {(x["a"], x["b"]): abs(x["r"] or 0.0) for x in pearson(long).collect()}  # pairs of sources
        vectors = np.array([[1.0 if a == b else r.get((min(a, b), max(a, b)), 0.0) for b in names] for a in names])
        weights = {x["source"]: x["weight"] or 0.0 for x in meta.collect()}
        heaviest = lambda of: min(of, key=lambda n: (-weights.get(n, 0.0), n))
        clusters = column_clusters(names, np.nan_to_num(vectors), min(3, len(names) // 2), heaviest(names), rounds)
        reps = [heaviest([n for n in names if clusters[n] == c]) for c in sorted(set(clusters.values()))]
    hit = F.max(F.when(F.col("source").isin(reps), F.col("event")).otherwise(0))
    return events.groupBy("row_id").agg(hit.alias("label_clustered"))


def robust_normalised(df: DataFrame, keys: list[str], x: str, quantiles: tuple[float, float] = DEFAULTS.risk_quantiles, name: str = "z") -> DataFrame:
    """df with x between two quantiles as 0 to 1, clipped; nulls count as the lower one; 0 if they don't differ."""
    q = exact_quantiles(df, keys, x, list(quantiles))
    lo, hi = F.col("q0"), F.col("q1")
    z = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce(F.col(x), lo) - lo) / F.when(hi > lo, hi - lo)))).otherwise(0.0)
    t = df.join(F.broadcast(q), keys, "left") if keys else df.crossJoin(F.broadcast(q))
    return t.withColumn(name, F.coalesce(z, F.lit(0.0))).drop("q0", "q1")


def risk_score(events: DataFrame, meta: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """row_id, risk_score_raw, risk_percentile, risk_score_0_100: normalised severities, weighted by source, window and rarity, summed and ranked."""
    events = written(events.select("row_id", "source", "event", "severity"), "events")  # read three times
    z = robust_normalised(events, ["source"], "severity", s.risk_quantiles)
    rate = events.groupBy("source").agg(F.avg("event").alias("pi"))
    window = F.lit(s.window_weights["unknown"])
    for tag, w in s.window_weights.items():
        window = F.when(F.col("window") == tag, w).otherwise(window)
    rarity = F.least(1 / F.sqrt(F.greatest("pi", F.lit(s.rarity[0]))), F.lit(s.rarity[1]))
    factor = meta.join(rate, "source").select("source", (F.col("weight") * window * rarity).alias("factor"))
    raw = z.join(F.broadcast(factor), "source").groupBy("row_id").agg(F.round(F.sum(F.col("z") * F.col("factor")), 9).alias("risk_score_raw"))
    return percentile_ranks(raw, "risk_score_raw")


def percentile_ranks(df: DataFrame, column: str) -> DataFrame:
    """df with risk_percentile, the average rank over the number of rows, and risk_score_0_100, that in hundredths of a percent, halves to even."""
    df = written(df, "ranked")
    t = average_ranks(df, [], column).crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    p = F.col("rank") / F.col("_n")
    return t.withColumn("risk_percentile", p).withColumn("risk_score_0_100", F.bround(100 * F.col("risk_percentile"), 2)).drop("rank", "_n")


def threshold_sweep(scored: DataFrame, thresholds: list[float], column: str = "wscore") -> DataFrame:
    """threshold, positive_rate: the share of rows at or above each."""
    hits = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col(column) >= t).cast("int").alias("hit")) for t in thresholds))
    return scored.select(F.explode(hits).alias("h")).groupBy("h.threshold").agg(F.avg("h.hit").alias("positive_rate"))


def per_source_labels(events: DataFrame, meta: DataFrame, least: float = 0.9) -> DataFrame:
    """row_id and label_<source> for each source of at least this weight."""
    heavy = [r["source"] for r in meta.where(F.col("weight") >= least).orderBy("source").collect()]
    return events.groupBy("row_id").agg(*(F.max(F.when(F.col("source") == h, F.col("event")).otherwise(0)).alias(f"label_{h}") for h in heavy)) if heavy else events.select("row_id").distinct()


def candidate_table(prof: DataFrame, rates: DataFrame, meta: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """variable with window, quality, scores, threshold and eligibility. meta: variable, text (a column of patterns.text)."""
    from ..functions import patterns as P

    t = prof.withColumnRenamed("feature", "variable").join(rates.withColumnRenamed("feature", "variable"), "variable").join(F.broadcast(meta), "variable")
    quality = F.when(F.col("n_unique") <= 1, 0.0).when(F.col("missing") > 0.8, 0.3).when(F.col("missing") > 0.5, 0.7).otherwise(1.0)
    score = P.outcome_score(F.col("text"))
    rate = F.col("event_positive_rate")
    eligible = (score >= s.outcome_score) & (quality > s.label_quality) & rate.between(*s.prevalence)
    window: Column = P.window_tag(F.col("text"))
    return t.where(window != "lt").select("variable", window.alias("window"), score.alias("outcome_score"), quality.alias("quality_score"), (score * quality).alias("combined_score"), "event_threshold", "event_positive_rate", eligible.alias("eligible_for_label"))


def negative_pattern_table(prof: DataFrame, meta: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """variable of those with a negative pattern: counts, priority_score and recommended_for_label."""
    from ..functions import patterns as P

    t = prof.withColumnRenamed("feature", "variable").join(F.broadcast(meta), "variable")
    n = P.negative_count(F.col("text"))
    discrete = F.col("is_binary") | F.col("is_integer_like")
    common = F.col("positive_rate").between(*s.prevalence)
    priority = F.when(F.col("missing") < 0.1, 0.4).when(F.col("missing") < 0.3, 0.2).otherwise(0.0) + F.when(discrete, 0.3).otherwise(0.0) + F.when(common, 0.3).otherwise(0.0)
    t = t.where((n > 0) & (P.window_tag(F.col("text")) != "lt"))
    return t.select(
        "variable", n.alias("pattern_count"), "is_binary", "is_integer_like", F.col("positive_rate").alias("event_positive_rate"), F.col("missing").alias("missing_pct"), "n_unique",
        priority.alias("priority_score"), (discrete & common & (F.col("missing") < 0.5) & (F.round(priority, 9) >= 0.6)).alias("recommended_for_label"),
    )
