"""Feature transforms on the long layout, and encoders of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..scratch import written
from .order import exact_quantiles
from .profile import clean

MISSING = "__MISSING__"


def one_hot(df: DataFrame, column: str, most: int = DEFAULTS.one_hot_levels) -> DataFrame | None:
    """df with <column>__is_<level> for each level, missing being one; None if there are more than most levels."""
    level = F.coalesce(F.col(column), F.lit(MISSING))
    levels = [r[0] for r in df.select(level.alias("l")).distinct().orderBy("l").limit(most + 1).collect()]
    return None if len(levels) > most else df.withColumns({f"{column}__is_{v[:30]}": (level == v).cast("int") for v in levels})


def frequency(df: DataFrame, column: str) -> DataFrame:
    """df with <column>__freq: the share of rows with the same level, missing being one."""
    level = F.coalesce(F.col(column), F.lit(MISSING))
    counts = df.groupBy(level.alias("_level")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    shares = counts.crossJoin(F.broadcast(total)).select("_level", (F.col("_n") / F.col("_all")).alias(f"{column}__freq"))
    return df.join(shares, level == F.col("_level"), "left").drop("_level")


def encoded_categories(df: DataFrame, columns: list[str], most: int = DEFAULTS.one_hot_levels) -> tuple[DataFrame, list[str]]:
    """df with the features of each category, dummies for at most most levels, else frequencies; and the features' names."""
    before = set(df.columns)
    for c in columns:
        dummies = one_hot(df, c, most)
        df = frequency(df, c) if dummies is None else dummies
    return df, [c for c in df.columns if c not in before]


def top_dummies(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """df with dummies of the k most frequent levels; ties by name."""
    top = [r[0] for r in df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).collect()]
    return df.withColumns({f"{column}__top_{v[:30]}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in top})


def target_encode(df: DataFrame, column: str, fold: str = "fold") -> DataFrame:
    """df with <column>__te: the mean of y over the other folds' rows of the level, or of all their rows where there is none."""
    level = F.coalesce(F.col(column), F.lit(MISSING))
    by = df.groupBy(level.alias("_level"), F.col(fold).alias("_fold")).agg(F.sum("y").alias("s"), F.count("y").alias("c"))
    whole = by.groupBy("_level").agg(F.sum("s").alias("sl"), F.sum("c").alias("cl"))
    folds = by.groupBy("_fold").agg(F.sum("s").alias("sf"), F.sum("c").alias("cf"))
    total = folds.agg(F.sum("sf").alias("st"), F.sum("cf").alias("ct"))
    t = by.join(whole, "_level").join(F.broadcast(folds), "_fold").crossJoin(F.broadcast(total))
    n = F.col("cl") - F.col("c")
    rest = F.col("ct") - F.col("cf")
    te = F.when(n > 0, (F.col("sl") - F.col("s")) / F.when(n > 0, n)).otherwise((F.col("st") - F.col("sf")) / F.when(rest > 0, rest))
    t = t.select("_level", "_fold", te.alias(f"{column}__te"))
    return df.join(t, (level == F.col("_level")) & (F.col(fold) == F.col("_fold")), "left").drop("_level", "_fold")


def impute_median(long: DataFrame) -> DataFrame:
    """long with missing x replaced by the feature's median, or 0 if it has none."""
    return long.join(F.broadcast(exact_quantiles(long, ["feature"], "x", [0.5])), "feature", "left").withColumn("x", F.coalesce("x", "q0", F.lit(0.0))).drop("q0")


def numeric_transform(long: DataFrame, kinds: DataFrame) -> DataFrame:
    """long with x as log1p(x - least if that is negative) for counts, else asinh(x). kinds: feature, kind."""
    least = long.groupBy("feature").agg(F.min("x").alias("_least"))
    t = long.join(F.broadcast(kinds), "feature").join(F.broadcast(least), "feature")
    shift = F.when(F.col("_least") < 0, -F.col("_least")).otherwise(0.0)
    return t.withColumn("x", F.when(F.col("kind") == "count", F.log1p(F.col("x") + shift)).otherwise(F.asinh("x"))).drop("kind", "_least")


def robust_scale(long: DataFrame) -> DataFrame:
    """long with (x - median) / interquartile range, which counts as 1 if it is 0."""
    q = exact_quantiles(long, ["feature"], "x", [0.25, 0.5, 0.75])
    iqr = F.col("q2") - F.col("q0")
    return long.join(F.broadcast(q), "feature").withColumn("x", (F.col("x") - F.col("q1")) / F.when(iqr == 0, 1.0).otherwise(iqr)).drop("q0", "q1", "q2")


def impute_scale(long: DataFrame) -> DataFrame:
    """robust_scale(impute_median(long)), each step written once, as the next reads it twice."""
    filled = written(impute_median(written(long, "long")), "imputed")
    return robust_scale(filled)


def standard_scale(long: DataFrame, centre: bool = True) -> DataFrame:
    """long with x over its population deviation (1 if 0), minus the mean if centre; missing becomes 0."""
    m = long.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    s = F.when(F.coalesce("_s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))
    return long.join(F.broadcast(m), "feature").withColumn("x", F.coalesce((F.col("x") - (F.col("_m") if centre else F.lit(0.0))) / s, F.lit(0.0))).drop("_m", "_s")


def winsorise(long: DataFrame, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    q = exact_quantiles(long, ["feature"], "x", [lo, hi])
    return long.join(F.broadcast(q), "feature", "left").withColumn("x", F.when(F.col("x").isNotNull(), F.least(F.greatest("x", "q0"), F.col("q1")))).drop("q0", "q1")


def fill_zero(long: DataFrame) -> DataFrame:
    return long.withColumn("x", F.coalesce("x", F.lit(0.0)))


def sanitise(long: DataFrame, least_std: float = DEFAULTS.least_std) -> DataFrame:
    """long with infinities and NaN as missing, missing as medians, without features that are constant then."""
    t = written(impute_median(long.withColumn("x", clean(F.col("x")))), "sane")
    live = t.groupBy("feature").agg(F.stddev_samp("x").alias("s")).where(F.col("s") > least_std).select("feature")
    return t.join(F.broadcast(live), "feature", "left_semi")


def to_wide(long: DataFrame, features: list[str], ids: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """A row for each id; the given features as columns of single precision, for the sink."""
    return long.where(F.col("feature").isin(features)).groupBy(*ids).pivot("feature", features).agg(F.first("x").cast("float"))
