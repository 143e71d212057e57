"""Readers: tables, dictionaries, catalogs, guard lists, targets and splits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema all columns are strings: no pass over the data guesses types."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def pick_columns(columns: list[str], strategy: str = "first") -> tuple[str | None, str | None]:
    """The name and description columns of a dictionary. first and last: the first or last match of a word; exact: whole names before parts, else the first column."""
    names, texts = ("variable", "field", "column", "name"), ("explanation", "description", "meaning", "detail")
    low = {c: c.strip().lower() for c in columns}
    if strategy == "exact":
        def pick(words: tuple[str, ...], default: str | None) -> str | None:
            whole = [c for w in words for c in columns if low[c] == w]
            part = [c for c in columns if any(w in low[c] for w in words)]
            return (whole or part or [default])[0]

        return pick(("variable name", *names, "feature"), columns[0] if columns else None), pick((*texts, "note", "notes"), None)
    if strategy == "last":  # a column serves one role: names first
        name = [c for c in columns if any(w in low[c] for w in names)]
        text = [c for c in columns if c not in name and any(w in low[c] for w in texts)]
        return (name or [None])[-1], (text or [None])[-1]
    if strategy != "first":
        raise ValueError(f"unknown strategy {strategy}")
    return next((c for c in columns if any(w in low[c] for w in names)), None), next((c for c in columns if any(w in low[c] for w in texts)), None)


def dictionary(df: DataFrame, strategy: str = "first") -> DataFrame:
    """variable, description of a dictionary table, found by its column names."""
    name, text = pick_columns(df.columns, strategy)
    if name is None:
        raise ValueError("no column of names")
    return df.where(F.col(name).isNotNull()).select(F.trim(F.col(name)).alias("variable"), (F.col(text) if text else F.lit("")).cast("string").alias("description"))


def merge_catalog(words: DataFrame, catalog: DataFrame) -> DataFrame:
    """variable, description: the dictionary's, else the catalog's (Variable, Description)."""
    c = catalog.select(F.col("Variable").alias("variable"), F.col("Description").alias("_d")).dropDuplicates(["variable"])
    return words.join(c, "variable", "full").select("variable", F.coalesce("description", "_d").alias("description"))


def guard_lists(spark: SparkSession, *paths: str) -> DataFrame:
    """column of text files with a name on each line."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("column")).where("column <> ''").distinct()


def settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def monotone(path: str, features: list[str]) -> list[int]:
    """The constraint of each feature (0 where a JSON object names none)."""
    found = settings(path)
    return [int(found.get(f, 0)) for f in features]


def pick_target(columns: list[str], target: str | None = None, recommended: str | None = None, ids: tuple[str, ...] = ("row_id", "id", "user_id")) -> str:
    """The label column: the one asked for, else the recommended one, else the first that is no id."""
    for c in (target, recommended):
        if c and c in columns:
            return c
    if target:
        raise KeyError(target)
    return next(c for c in columns if c not in ids)


def preferred_label(columns: list[str]) -> str:
    order = ("label_union", "label_weighted", "label_hierarchical", "label_clustered")
    return next((c for c in order if c in columns), [c for c in columns if c not in ("row_id", "id", "user_id")][-1])


def split_parts(df: DataFrame, splits: DataFrame | None) -> dict[str, DataFrame] | None:
    """The rows of each split; None without splits."""
    if splits is None:
        return None
    t = df.join(splits.select("row_id", "split"), "row_id")
    return {s: t.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
