"""Quantile bins, weight of evidence, information value and binned mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .order import exact_quantiles
from .similarity import mutual_info


def edges(long: DataFrame, bins: int, keys: list[str] | None = None) -> DataFrame:
    """keys, edges: the inner quantiles of x (bins - 1 of them)."""
    keys = keys or ["feature"]
    q = exact_quantiles(long, keys, "x", [i / bins for i in range(1, bins)])
    return q.select(*keys, F.array(*(f"q{i}" for i in range(bins - 1))).alias("edges"))


def qcut(long: DataFrame, bins: int = DEFAULTS.bins) -> DataFrame:
    """long with bin: right-closed quantile bins without empty ones; features of at most bins values keep their values as bins."""
    unique = long.groupBy("feature").agg(F.count_distinct("x").alias("u"))
    t = long.where("x is not null").join(F.broadcast(edges(long, bins)), "feature").join(F.broadcast(unique), "feature")
    return t.withColumn("bin", F.when(F.col("u") > bins, F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col("x"))).cast("double")).otherwise(F.col("x"))).drop("edges", "u")


def digitize(long: DataFrame, bins: int = DEFAULTS.bins) -> DataFrame:
    """long with bin: left-closed bins at the inner quantiles, repeated ones kept."""
    t = long.where("x is not null").join(F.broadcast(edges(long, bins)), "feature")
    return t.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))).cast("double")).drop("edges")


def crosstab(binned: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, good (y = 0), bad (y = 1)."""
    keys = keys or ["feature"]
    return binned.groupBy(*keys, "bin").agg(F.count_if(F.col("y") == 0).alias("good"), F.count_if(F.col("y") == 1).alias("bad"))


def woe_smooth(tab: DataFrame, eps: float = 1e-6) -> DataFrame:
    """feature, bin, woe = ln(good / bad) of smoothed shares, and iv_part."""
    total = tab.groupBy("feature").agg(F.sum("good").alias("gt"), F.sum("bad").alias("bt"))
    g, b = (F.col("good") + eps) / (F.col("gt") + eps), (F.col("bad") + eps) / (F.col("bt") + eps)
    return tab.join(F.broadcast(total), "feature").select("feature", "bin", "good", "bad", F.log(g / b).alias("woe"), ((g - b) * F.log(g / b)).alias("iv_part"))


def woe_half(tab: DataFrame) -> DataFrame:
    """feature, bin, woe = ln(bad / good), cells of 0 counted as a half, quotients within 1e-6 and 1e6, and iv_part."""
    t = tab.select("feature", "bin", *(F.when(F.col(c) == 0, 0.5).otherwise(F.col(c).cast("double")).alias(c) for c in ("good", "bad")))
    total = t.groupBy("feature").agg(F.sum("good").alias("gt"), F.sum("bad").alias("bt"))
    g, b = F.col("good") / F.col("gt"), F.col("bad") / F.col("bt")
    woe = F.log(F.least(F.greatest(b / g, F.lit(1e-6)), F.lit(1e6)))
    return t.join(F.broadcast(total), "feature").select("feature", "bin", woe.alias("woe"), ((b - g) * woe).alias("iv_part"))


def information_value(woe: DataFrame) -> DataFrame:
    return woe.groupBy("feature").agg(F.sum("iv_part").alias("iv"))


def rare_collapse(df: DataFrame, column: str, least: int = DEFAULTS.rare_count, other: str = "__OTHER__") -> DataFrame:
    """df with levels of column (null is one) of fewer rows than least replaced by other."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(column).alias("_level"))
    kept = df.join(F.broadcast(counts.withColumn("_kept", F.lit(True))), F.col(column).eqNullSafe(F.col("_level")), "left")
    return kept.withColumn(column, F.when(F.col("_kept"), F.col(column)).otherwise(F.lit(other))).drop("_level", "_kept")


def categorical_woe(df: DataFrame, column: str, least: int = DEFAULTS.rare_count) -> DataFrame:
    t = rare_collapse(df, column, least).where(F.col(column).isNotNull())
    return woe_smooth(crosstab(t.select(F.lit(column).alias("feature"), F.col(column).alias("bin"), "y")))


def binned_mutual_info(long: DataFrame, bins: int = DEFAULTS.bins, binned: DataFrame | None = None) -> DataFrame:
    """feature, mi with y: left-closed quantile bins for features of more than bins values that aren't all integers, else the values. binned: digitize(long), if it is at hand."""
    kind = long.where("x is not null").groupBy("feature").agg((F.count_distinct("x") > bins).alias("many"), F.max(F.abs(F.col("x") - F.floor("x"))).alias("off"))
    t = (binned if binned is not None else digitize(long, bins)).join(F.broadcast(kind), "feature")
    t = t.withColumn("bin", F.when(F.col("many") & (F.col("off") > 0), F.col("bin")).otherwise(F.col("x")))
    return mutual_info(t.where("y is not null"), ["feature"], "bin", "y", 1e-12)


def kbins_mutual_info(long: DataFrame, bins: int | None = None) -> DataFrame:
    """feature, mi with y after missing values became medians and values quantile bins: a bin for each 3000 rows, from 2 to 10."""
    if bins is None:
        rows = long.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
        bins = min(10, max(2, rows // 3000))
    median = exact_quantiles(long, ["feature"], "x", [0.5])
    t = long.join(F.broadcast(median), "feature").withColumn("x", F.coalesce("x", "q0")).drop("q0")
    return mutual_info(digitize(t, bins).where("y is not null"), ["feature"], "bin", "y")
