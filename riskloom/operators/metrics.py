"""Rank metrics of scores against 0/1 labels: exact, with ties, for many features at once.

All work on counts of different scores and on two-level running totals, so no feature's rows meet in one task.
Input: df with keys (say feature), x and y; rows without x or y are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .order import exact_quantiles, prefix_sums


def counted(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, n, pos: kept, as totals and running totals read it several times."""
    return df.where("x is not null and y is not null").groupBy(*keys, F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos")).persist()


def _with_totals(t: DataFrame, keys: list[str]) -> DataFrame:
    total = t.groupBy(*keys).agg(F.sum("n").alias("nt"), F.sum("pos").alias("n1"))
    return t.join(F.broadcast(total), keys) if keys else t.crossJoin(F.broadcast(total))


def auc(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auc, gini: rank-sum with average ties; 0.5 if a class is empty."""
    t = prefix_sums(counted(df, keys), keys, ["x"], {"cum": "n"})
    s = t.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("cum") - F.col("n") / 2 + 0.5)).alias("s"), F.sum("pos").alias("n1"), F.sum("n").alias("nt"))
    n1, n0 = F.col("n1").cast("double"), (F.col("nt") - F.col("n1")).cast("double")
    a = F.when((n1 == 0) | (n0 == 0), 0.5).otherwise((F.col("s") - n1 * (n1 + 1) / 2) / F.when(n1 * n0 != 0, n1 * n0))
    return s.select(*keys, a.alias("auc"), (2 * a - 1).alias("gini"))


def average_precision(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ap: precision at each score from above, weighted by the positives there."""
    t = _with_totals(prefix_sums(counted(df, keys), keys, ["x"], {"cum_n": "n", "cum_pos": "pos"}, descending=True), keys)
    part = F.when(F.col("n1") > 0, F.col("cum_pos") / F.col("cum_n") * F.col("pos") / F.when(F.col("n1") > 0, F.col("n1"))).otherwise(0.0)
    return t.groupBy(*keys).agg(F.sum(part).alias("ap"))


def ks_roc(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ks: the most by which the true-positive rate leads, from high scores down, ties together."""
    t = _with_totals(prefix_sums(counted(df, keys), keys, ["x"], {"cum_n": "n", "cum_pos": "pos"}, descending=True), keys)
    n1, n0 = F.when(F.col("n1") > 0, F.col("n1")), F.when(F.col("nt") > F.col("n1"), F.col("nt") - F.col("n1"))
    return t.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max(F.col("cum_pos") / n1 - (F.col("cum_n") - F.col("cum_pos")) / n0)).alias("ks"))


def ks_rowwise(df: DataFrame, keys: list[str], row_id: str = "row_id") -> DataFrame:
    """keys, ks: the largest gap between the classes' cumulative shares after each row, ties in order of row_id."""
    rows = df.where("x is not null and y is not null").select(*keys, "x", row_id, F.lit(1).alias("n"), F.col("y").cast("bigint").alias("pos"))
    t = _with_totals(prefix_sums(rows, keys, ["x", row_id], {"cum_n": "n", "cum_pos": "pos"}), keys)
    n1, n0 = F.when(F.col("n1") > 0, F.col("n1")), F.when(F.col("nt") > F.col("n1"), F.col("nt") - F.col("n1"))
    return t.groupBy(*keys).agg(F.max(F.abs(F.col("cum_pos") / n1 - (F.col("cum_n") - F.col("cum_pos")) / n0)).alias("ks"))


def ks_grid(df: DataFrame, keys: list[str], points: int = DEFAULTS.ks_points) -> DataFrame:
    """keys, ks: the largest gap between the classes' distribution functions at so many quantiles of x."""
    t = counted(df, keys)
    grid = exact_quantiles(df.where("x is not null and y is not null"), keys, "x", [i / (points - 1) for i in range(points)])
    grid = grid.select(*keys, F.array(*(f"q{i}" for i in range(points))).alias("grid"))
    t = _with_totals(t.join(F.broadcast(grid), keys) if keys else t.crossJoin(F.broadcast(grid)), keys)
    # Each score counts at the grid points from its own place on.
    at = F.size(F.filter("grid", lambda g: g < F.col("x")))
    cells = t.groupBy(*keys, at.alias("at")).agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"), F.max("n1").alias("n1"), F.max("nt").alias("nt"))
    cells = prefix_sums(cells, keys, ["at"], {"cp": "pos", "cn": "neg"})
    n1, n0 = F.col("n1"), F.col("nt") - F.col("n1")
    share = lambda c, n: F.when(n > 0, c / F.when(n > 0, n)).otherwise(0.0)
    return cells.where(F.col("at") < points).groupBy(*keys).agg(F.max(F.abs(share(F.col("cp"), n1) - share(F.col("cn"), n0))).alias("ks"))


def brier_logloss(df: DataFrame, keys: list[str], p: str = "x", y: str = "y", eps: float = 1e-15) -> DataFrame:
    """keys, brier, logloss of probabilities; null, NaN and infinite ones count as 0."""
    q = F.when(F.col(p).isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(F.col(p))
    clipped = F.least(F.greatest(q, F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))
    return df.groupBy(*keys).agg(F.avg(F.pow(q - F.col(y), F.lit(2.0))).alias("brier"), F.avg(loss).alias("logloss"))


def numbered(df: DataFrame, row_id: str = "row_id", descending: bool = False) -> DataFrame:
    """df with place (1, 2, ...) by x and row_id, and nt, the number of rows."""
    rows = df.withColumn("_one", F.lit(1))
    if descending:  # the id breaks ties upwards in either direction
        rows = rows.withColumn("_neg", -F.col("x"))
        out = prefix_sums(rows, [], ["_neg", row_id], {"place": "_one"}).drop("_neg")
    else:
        out = prefix_sums(rows, [], ["x", row_id], {"place": "_one"})
    return out.drop("_one").crossJoin(F.broadcast(df.agg(F.count("*").alias("nt"))))


def deciles_by_rank(df: DataFrame, bins: int = DEFAULTS.bins, row_id: str = "row_id", from_riskiest: bool = False) -> DataFrame:
    """Decile table: bins of ranks as quantile cuts make them, 1 the riskiest; cumulative shares run from the safest bin, or from the riskiest."""
    t = numbered(df.where("x is not null"), row_id)
    cut = F.greatest(F.lit(1), F.ceil((F.col("place") - 1) * bins / (F.col("nt") - 1))).cast("int")
    t = t.groupBy((bins + 1 - cut).alias("decile")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("pos"), F.avg("x").alias("avg_p"))
    return _cumulative(t, "decile", from_riskiest)


def _cumulative(t: DataFrame, key: str, from_riskiest: bool) -> DataFrame:
    t = t.withColumn("neg", F.col("n") - F.col("pos")).withColumn("pos_rate", F.col("pos") / F.col("n"))
    t = prefix_sums(t, [], [key], {"cum_pos": "pos", "cum_neg": "neg"}, descending=not from_riskiest)
    total = t.agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    t = t.crossJoin(F.broadcast(total))
    rate = F.col("tp") / (F.col("tp") + F.col("tn"))
    tp = F.when(F.col("tp") > 0, F.col("tp"))
    return t.select(
        key, "n", "pos", "avg_p", "neg", "pos_rate", "cum_pos", "cum_neg", (F.col("cum_pos") / tp).alias("cum_pos_capture"),
        (F.col("cum_neg") / F.greatest(F.col("tn"), F.lit(1))).alias("cum_neg_share"), (F.col("pos_rate") / F.when(rate > 0, rate)).alias("lift"),
    )


def deciles_by_cut(df: DataFrame, bins: int = DEFAULTS.bins, row_id: str = "row_id") -> DataFrame:
    """Decile table: rows by falling score, cut at floor(n d / bins)."""
    t = numbered(df.where("x is not null"), row_id, descending=True)
    d = F.floor((F.col("place") * bins - 1) / F.col("nt")) + 1
    guess = [F.least(F.greatest(d + k, F.lit(1)), F.lit(bins)) for k in (-1, 0, 1)]
    inside = lambda g: (F.floor(F.col("nt") * (g - 1) / bins) < F.col("place")) & (F.col("place") <= F.floor(F.col("nt") * g / bins))
    t = t.withColumn("decile", F.coalesce(*(F.when(inside(g), g) for g in guess)).cast("int"))
    return t.groupBy("decile").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("positives"), F.avg(F.col("y").cast("double")).alias("rate"), F.min("x").alias("score_min"), F.max("x").alias("score_max"), F.avg("x").alias("score_mean")
    )


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auc, gini, ap, ks, brier, logloss of probabilities x."""
    out = auc(df, keys)
    for part in (average_precision(df, keys), ks_roc(df, keys), brier_logloss(df, keys)):
        out = out.join(part, keys) if keys else out.crossJoin(part)
    return out
