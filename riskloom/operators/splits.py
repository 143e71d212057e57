"""Deterministic stratified splits: rows of a class in order of md5(row_id|seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .order import prefix_sums, with_each


def _placed(df: DataFrame, seed: int) -> DataFrame:
    """df with _place within its class and _n, the rows of the class. Rows without y are a class of their own."""
    key = F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(seed))))
    t = df.withColumns({"_key": key, "_one": F.lit(1), "_head": F.conv(F.substring(key, 1, 12), 16, 10).cast("double")})
    t = prefix_sums(t, ["y"], ["_head", "_key", "row_id"], {"_place": "_one"})
    return with_each(t, df.groupBy("y").agg(F.count("*").alias("_n")), ["y"]).drop("_key", "_one", "_head")


def stratified_split(df: DataFrame, parts: dict[str, float] | None = None, seed: int = DEFAULTS.seed) -> DataFrame:
    """df (row_id, y) with split: shares of each class in the order of parts, which must sum to 1."""
    parts = parts or {"train": 0.70, "val": 0.15, "test": 0.15}
    if abs(sum(parts.values()) - 1) > 1e-9 or min(parts.values()) < 0:
        raise ValueError("shares must be non-negative and sum to 1")
    share = (F.col("_place") - 1) / F.col("_n")
    names, split, upto = list(parts), F.lit(list(parts)[-1]), 0.0
    ends = []
    for name in names[:-1]:
        upto += parts[name]
        ends.append((name, upto))
    for name, end in reversed(ends):
        split = F.when(share < F.lit(end), name).otherwise(split)
    return _placed(df, seed).withColumn("split", split).drop("_place", "_n")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = DEFAULTS.seed) -> DataFrame:
    """df (row_id, y) with fold, 0 to k - 1, dealt in turn within each class."""
    if k < 2:
        raise ValueError("at least two folds")
    return _placed(df, seed).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_n")


def holdout(df: DataFrame, share: float = 0.25, seed: int = DEFAULTS.seed) -> DataFrame:
    return stratified_split(df, {"test": share, "train": 1 - share}, seed)


def alignment(a: DataFrame, b: DataFrame, key: str = "row_id") -> Column | DataFrame:
    """One row: how many keys each side lacks; both are 0 for tables that line up."""
    left = a.join(b, key, "left_anti").agg(F.count("*").alias("only_left"))
    return left.crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("only_right")))
