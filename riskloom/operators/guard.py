"""The guard: columns that must not become features, each with the first reason that bans it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def first_reasons(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """column, reason: rules (reason, DataFrame with column) in order of priority; the first one that names a column counts."""
    parts = [df.select(F.col("column"), F.lit(i).alias("_p"), F.lit(r).alias("reason")) for i, (r, df) in enumerate(rules)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("column").agg(F.min(F.struct("_p", "reason")).alias("x")).select("column", F.col("x.reason").alias("reason"))


def snapshot_guard(
    meta: DataFrame, external: DataFrame | None = None, labels: DataFrame | None = None, sources: DataFrame | None = None, near_unique: DataFrame | None = None,
    forbidden_windows: tuple[str, ...] = ("lt",), prefixes: tuple[str, ...] = ("refdate_",), compat: bool = False,
) -> DataFrame:
    """column, reason over meta (column_name, description): external list, labels, sources, ids, near-unique, outcome text, lifetime, windows, prefixes, time."""
    t, name = P.text(), F.col("column_name")
    at = lambda test: meta.where(test).select(name.alias("column"))
    prefixed: Column = reduce(lambda a, b: a | b, (name.startswith(p) for p in prefixes), F.lit(False))
    rules = [("external_guard_list", external), ("label_columns", labels), ("label_source_exact", sources), ("id_like", at(P.is_id_like(name))), ("near_unique", near_unique)]
    rules += [("outcome_like_text", at(P.is_outcome_like(t))), ("lifetime_window", at(P.is_lifetime(t)))]
    if forbidden_windows:
        rules.append((f"forbid_windows:{','.join(sorted(forbidden_windows))}", at(P.window_tag(t, compat).isin(*forbidden_windows))))
    rules += [(f"ban_prefixes:{','.join(prefixes)}", at(prefixed)), ("time_like_literal", at(P.is_time_like(t, compat)))]
    return first_reasons([(r, d) for r, d in rules if d is not None])


def framework_guard(meta: DataFrame, sources: list[str], strict: bool = True) -> DataFrame:
    """column: sources, their families and, if strict, whatever reads like an outcome."""
    name = F.col("column_name")
    families = meta.where(name.isin(sources)).select(P.family(name).alias("family")).distinct()
    out = meta.where(name.isin(sources)).select(name.alias("column")).unionByName(meta.join(F.broadcast(families), P.family(name) == F.col("family"), "left_semi").select(name.alias("column")))
    return (out.unionByName(meta.where(P.is_outcome_like(P.text())).select(name.alias("column"))) if strict else out).distinct()


def leak_report(meta: DataFrame, spearman: DataFrame, aucs: DataFrame) -> DataFrame:
    """column, reason of leaks: by name, by description, |spearman| >= 0.999, single-feature AUC >= 0.995. spearman: feature, r; aucs: feature, auc."""
    name = F.col("column_name")
    parts = [
        meta.where(P.has_leak_token(name)).select(name.alias("column"), F.lit("name_token").alias("reason")),
        meta.where(P.has_leak_token(F.coalesce("description", F.lit("")))).select(name.alias("column"), F.lit("description_token").alias("reason")),
        spearman.where(F.abs("r") >= 0.999).select(F.col("feature").alias("column"), F.lit("spearman").alias("reason")),
        aucs.where(F.greatest(F.col("auc"), 1 - F.col("auc")) >= 0.995).select(F.col("feature").alias("column"), F.lit("single_feature_auc").alias("reason")),
    ]
    return reduce(DataFrame.unionByName, parts)


def guard_from_lines(lines: DataFrame, *more: DataFrame) -> DataFrame:
    """column from lines (value) of name or name,reason, and from further tables with column."""
    own = lines.select(F.trim(F.split("value", ",")[0]).alias("column")).where(~F.col("column").isin("", "variable"))
    return reduce(DataFrame.unionByName, [m.select("column") for m in more], own).distinct()


def auto_guard(meta: DataFrame, tokens: list[str]) -> DataFrame:
    return meta.where(P.contains_any(F.lower("column_name"), tokens)).select(F.col("column_name").alias("column"))


# Words in a description that tell an outcome.
OUTCOME_TOKENS = "default dpd overdue writeoff chargeoff npa miss overlimit declin reject negative due penalty".split()


def verification_guard(meta: DataFrame, sources: list[str], tokens: list[str] = OUTCOME_TOKENS) -> DataFrame:
    """column: the sources of labels, and columns whose description holds a token."""
    told = P.contains_any(F.lower(F.coalesce("description", F.lit(""))), tokens)
    return meta.where(told | F.col("column_name").isin(sources)).select(F.col("column_name").alias("column")).unionByName(meta.sparkSession.createDataFrame([(x,) for x in sources], "column string")).distinct()


def guard_from_buckets(path_or_rows: DataFrame) -> DataFrame:
    """column from rows whose columns are buckets, each an array of names (a JSON file of lists, as Spark reads it)."""
    names = F.flatten(F.array(*(F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) for c in path_or_rows.columns)))
    return path_or_rows.select(F.explode(names).alias("column")).where("column is not null").distinct()


def forbidden_windows(meta: DataFrame, sources: list[str]) -> list[str]:
    """The windows of the label sources in use, which features must then avoid."""
    return sorted(r[0] for r in meta.where(F.col("column_name").isin(sources)).select(P.window_tag(P.text()).alias("w")).where("w <> 'unknown'").distinct().collect())


def reason_counts(guard: DataFrame) -> DataFrame:
    return guard.groupBy("reason").agg(F.count("*").alias("n_columns"))


def too_predictive(aucs: DataFrame, most: float = 0.88) -> DataFrame:
    return aucs.where(F.greatest(F.col("auc"), 1 - F.col("auc")) > most).select(F.col("feature").alias("column"))


def auc_band(auc: Column) -> Column:
    return F.when(auc > 0.95, "suspicious").when(auc > 0.80, "strong").when(auc > 0.60, "fair").otherwise("weak")


def keep_ordinals(columns: list[str], guard: DataFrame) -> list[str]:
    """The columns outside the guard, in their own order."""
    banned = {r[0] for r in guard.select("column").collect()}  # column names
    return [c for c in columns if c not in banned]


