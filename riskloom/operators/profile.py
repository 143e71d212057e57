"""Column profiles on the long layout (row_id, feature, x): one pass for all columns instead of hundreds of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import patterns as P
from .order import exact_quantiles


def clean(x: Column) -> Column:
    """Null for NaN and infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def to_long(df: DataFrame, columns: list[str], ids: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """ids, feature, x: a row for each row and column; NaN and infinities become null."""
    return df.select(*ids, *(clean(F.col(c)).alias(c) for c in columns)).unpivot(list(ids), columns, "feature", "x")


def value_counts(long: DataFrame) -> DataFrame:
    """feature, x, n and share: of the rows with a value, how many have each one."""
    counts = long.where("x is not null").groupBy("feature", "x").agg(F.count("*").alias("n"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total), "feature").select("feature", "x", "n", (F.col("n") / F.col("_all")).alias("share"))


def profile(long: DataFrame) -> DataFrame:
    """A row for each feature: counts, missing share, distinct values, dominant share, moments (bias-corrected), tests for 0/1 and integers.

    Counts of values come first, so every later step works on different values only. A feature without a value has null moments.
    """
    counts = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    n, x = F.col("n"), F.col("x")
    base = counts.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(x.isNotNull(), n)), F.lit(0)).alias("n_values"),
        F.sum(F.when(x.isNotNull(), 1).otherwise(0)).alias("n_unique"),
        F.coalesce(F.max(F.when(x.isNotNull(), n)), F.lit(0)).alias("_top"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        F.coalesce(F.max(F.when(~x.isin(0.0, 1.0), 1)), F.lit(0)).alias("_other"),
        F.max(F.pmod(x, F.lit(1.0))).alias("_frac"),
        F.coalesce(F.sum(F.when(x > 0, n)), F.lit(0)).alias("n_positive"),
    )
    d = x - F.col("mean")
    moments = counts.where("x is not null").join(F.broadcast(base.select("feature", "mean")), "feature").groupBy("feature").agg(*(F.sum(F.pow(d, F.lit(float(k))) * n).alias(f"_m{k}") for k in (2, 3, 4)))
    out = base.join(F.broadcast(moments), "feature", "left")
    c = F.col("n_values").cast("double")
    variance = F.when(c > 1, F.col("_m2") / (c - 1))
    skew = F.sqrt(c) * F.col("_m3") / F.pow(F.col("_m2"), F.lit(1.5))
    kurt = c * F.col("_m4") / F.pow(F.col("_m2"), F.lit(2.0)) - 3
    spread = F.col("_m2") > 0
    return out.select(
        "feature",
        "n_rows",
        (1 - F.col("n_values") / F.col("n_rows")).alias("missing"),
        "n_unique",
        (F.col("_top") / F.col("n_rows")).alias("dominant_share"),
        "min",
        "max",
        "mean",
        variance.alias("variance"),
        F.sqrt(variance).alias("std"),
        F.when(spread & (c > 2), F.sqrt(c * (c - 1)) / (c - 2) * skew).alias("skewness"),
        F.when(spread & (c > 3), (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * kurt + 6)).alias("kurtosis"),
        ((F.col("n_unique") <= 2) & (F.col("_other") == 0)).alias("is_binary"),
        (F.coalesce(F.col("_frac") <= 1e-8, F.lit(False))).alias("is_integer_like"),
        (F.col("n_positive") / F.col("n_rows")).alias("positive_rate"),
    )


def fill_rate_filter(long: DataFrame, least: float = DEFAULTS.fill_rate) -> DataFrame:
    """feature and fill_rate of the features that are filled well enough."""
    return long.groupBy("feature").agg((F.count("x") / F.count("*")).alias("fill_rate")).where(F.col("fill_rate") >= least)


def column_filters(prof: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """What each drop rule says of a feature: too sparse, hardly varying, nearly constant, constant after filling with 0."""
    return prof.select(
        "feature",
        (F.col("missing") > s.hard_missing).alias("hard_missing"),
        (F.col("dominant_share") >= s.near_constant).alias("near_constant"),
        (F.coalesce("variance", F.lit(0.0)) <= s.least_variance).alias("low_variance"),
        (F.coalesce("std", F.lit(0.0)) <= s.least_std).alias("constant_feature"),
    )


def event_rates(long: DataFrame, prof: DataFrame, q: float = DEFAULTS.event_quantile) -> DataFrame:
    """feature, event_threshold and event_positive_rate: of 0/1 and integer features the share above 0, of others the share at or above their quantile q."""
    cut = exact_quantiles(long, ["feature"], "x", [q])
    kind = prof.select("feature", "n_rows", (F.col("is_binary") | F.col("is_integer_like")).alias("_discrete"), "positive_rate").join(cut, "feature", "left")
    above = long.join(F.broadcast(kind.where("not _discrete").select("feature", "q0")), "feature").where("x >= q0").groupBy("feature").agg(F.count("*").alias("_above"))
    out = kind.join(above, "feature", "left")
    return out.select(
        "feature",
        F.when(F.col("_discrete"), F.lit(0.0)).otherwise(F.col("q0")).alias("event_threshold"),
        F.when(F.col("_discrete"), F.col("positive_rate")).otherwise(F.coalesce("_above", F.lit(0)) / F.col("n_rows")).alias("event_positive_rate"),
    )


def quality_score(prof: DataFrame) -> DataFrame:
    """feature, quality (0 to 1, for missing values, a dominant value and too few different ones) and usable."""
    missing, dominant, n = F.col("missing"), F.col("dominant_share"), F.col("n_rows")
    unique = F.col("n_unique") / n
    q = F.when(missing > 0.8, 0.1).when(missing > 0.5, 0.5).when(missing > 0.2, 0.8).otherwise(1.0)
    q = q * F.when(F.col("n_unique") <= 1, 0.0).when(dominant > 0.99, 0.2).when(dominant > 0.95, 0.5).otherwise(1.0)
    q = q * F.when((F.col("n_unique") > 1) & (unique < 0.01), 0.8).otherwise(1.0)
    return prof.select("feature", q.alias("quality"), ((q > 0.3) & (missing < 0.9)).alias("usable"))


def near_unique(long: DataFrame, share: float = DEFAULTS.near_unique, strict: bool = False) -> DataFrame:
    """feature of numeric columns that look like ids. strict: any with so many different values, null being one; else integers beyond 1e7 alone."""
    counts = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    out = counts.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("x").isNotNull(), 1).otherwise(1 if strict else 0)).alias("unique"), F.max(F.abs("x")).alias("most"), F.max(F.abs(F.col("x") - F.rint("x"))).alias("off")
    )
    test = F.col("unique") >= share * F.col("rows")
    return out.where(test if strict else test & (F.col("off") < 1e-8) & (F.col("most") > 1e7)).select("feature")


def near_unique_strings(df: DataFrame, columns: list[str], share: float = DEFAULTS.near_unique) -> DataFrame:
    """feature of string columns that look like ids: nearly all values differ (null is one), or over 95 % look hexadecimal."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "feature", "s")
    counts = long.groupBy("feature", "s").agg(F.count("*").alias("n"))
    hexish = F.coalesce(F.col("s").rlike(r"^[0-9a-fA-F\-]{8,}$"), F.lit(False))
    out = counts.groupBy("feature").agg(F.sum("n").alias("rows"), F.count("*").alias("unique"), F.sum(F.when(hexish, F.col("n")).otherwise(0)).alias("hex"))
    return out.where((F.col("unique") >= share * F.col("rows")) | (F.col("hex") > 0.95 * F.col("rows"))).select("feature")


def sanity(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, columns, and how many cells are missing (null or NaN) or infinite."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "x")
    return long.agg(
        (F.count("*") / len(columns)).cast("bigint").alias("n_rows"), F.lit(len(columns)).cast("bigint").alias("n_columns"),
        F.count_if(F.col("x").isNull() | F.isnan("x")).alias("n_missing"), F.count_if(F.abs("x") == float("inf")).alias("n_infinite"),
    )


def missing_flags(long: DataFrame) -> DataFrame:
    """long with x replaced by 1 where it was missing, else 0, and feature by feature__isna."""
    return long.withColumns({"feature": F.concat("feature", F.lit("__isna")), "x": F.col("x").isNull().cast("double")})


def top_k(df: DataFrame, score: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(name)).limit(k)


def histogram(long: DataFrame, bins: int = 20) -> DataFrame:
    """feature, bin and n of equal-width bins: the table behind a plot."""
    ends = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / F.when(width != 0, width)), F.lit(bins - 1)))
    return long.where("x is not null").join(F.broadcast(ends), "feature").groupBy("feature", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """n rows, the same ones every time: those with the least md5 of key and seed."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def by_type(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """The columns that hold numbers or booleans, and the others, in their own order."""
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")]
    return numeric, [c for c in columns if c not in set(numeric)]


def truncated(df: DataFrame, column: str, n: int) -> DataFrame:
    """df with the first n characters of column."""
    return df.withColumn(column, F.substring(column, 1, n))


def heatmap_table(edges: DataFrame, value: str, names: list[str], diagonal: float = 1.0) -> DataFrame:
    """a, b, value of every two names, both ways round; edges (a, b, value) that lack one count as 0. The table behind a heat map."""
    spark = edges.sparkSession
    grid = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    both = edges.select("a", "b", F.col(value).alias("value")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col(value).alias("value")))
    return grid.join(F.broadcast(both), ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), diagonal).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))


def bar_table(df: DataFrame, name: str, value: str, k: int = 30) -> DataFrame:
    """place, name, value of the k largest values, ties by name: the table behind a bar chart."""
    top = top_k(df.select(F.col(name).alias("name"), F.col(value).alias("value")), "value", "name", k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "name")))  # k rows


def value_kinds(long: DataFrame, words: DataFrame) -> DataFrame:
    """feature, non_negative, integral, small, kind: count, ratio, amount or other by the words of words (feature, t), else by shares of the feature's values: those from 0 on, whole ones, and those from -5 to 5.

    Features without a value have null shares and are judged by words alone.
    """
    x = F.when(~F.isnan("x"), F.col("x"))
    share = lambda test: F.avg(F.when(x.isNotNull(), test.cast("double")))
    shares = long.groupBy("feature").agg(share(x >= 0).alias("non_negative"), share(x == F.floor(x)).alias("integral"), share(x.between(-5, 5)).alias("small"))
    t = shares.join(F.broadcast(words), "feature", "left").withColumn("t", F.coalesce("t", F.col("feature")))  # a row a feature
    return t.select("feature", "non_negative", "integral", "small", P.numeric_kind(F.col("t"), F.col("non_negative"), F.col("integral"), F.col("small")).alias("kind"))
