"""Coercion of booleans and numbers, and the value transforms of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of the two dialects.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "t", "1"), ("false", "no", "n", "f", "0")
TRUE_FEW, FALSE_FEW = ("true", "yes", "y"), ("false", "no", "n")


def bool_or_number(c: Column, is_string: bool = True) -> Column:
    """1, 0 or null for strings, trimmed, in either case (any other string is null); numbers pass."""
    if not is_string:
        return c.cast("double")
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), 1.0).when(word.isin(*FALSE_WORDS), 0.0)


def bool_few(c: Column, is_string: bool = True) -> Column:
    """The stricter dialect: no trimming, no single t, f, 1 or 0."""
    if not is_string:
        return c.cast("double")
    word = F.lower(c)
    return F.when(word.isin(*TRUE_FEW), 1.0).when(word.isin(*FALSE_FEW), 0.0)


def boolify(c: Column, is_string: bool = True) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(bool_few(c, is_string), F.lit(0.0))))


def severity(x: Column, mode: str = "log1p", cap: float = 10.0, least: Column | None = None, most: Column | None = None) -> Column:
    """log1p, asinh, signed_asinh, cap, raw or auto; nulls become 0. auto needs the column's least and most value."""
    positive = F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))
    raw = F.coalesce(x, F.lit(0.0))
    if mode == "log1p":
        return F.log1p(positive)
    if mode == "asinh":
        return F.asinh(positive)
    if mode == "signed_asinh":
        return F.asinh(raw)
    if mode == "cap":
        return F.least(positive, F.lit(float(cap)))
    if mode == "raw":
        return raw
    if mode == "auto" and least is not None and most is not None:
        return F.when(least >= 0, F.when(most <= 1, raw).otherwise(F.log1p(F.greatest(raw, F.lit(0.0))))).otherwise(F.asinh(raw))
    raise ValueError(f"unknown mode {mode}, or auto without least and most")
