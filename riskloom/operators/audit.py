"""The leakage audit: what each feature alone says about the label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..scratch import written
from . import metrics
from .binning import binned_mutual_info, crosstab, digitize, information_value, woe_half
from .profile import missing_flags
from .similarity import phi_of
from .order import ratio


def against_label(long: DataFrame) -> DataFrame:
    """feature, jaccard and phi with y for 0/1 features (else null), and the share of rows where x equals y."""
    u, v = (F.col("x") > 0).cast("int"), (F.col("y") > 0).cast("int")
    n = lambda i, j: F.sum(((u == i) & (v == j)).cast("bigint"))
    t = long.where("x is not null").groupBy("feature").agg(
        n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"), F.max((~F.col("x").isin(0.0, 1.0)).cast("int")).alias("other"), F.avg((F.col("x") == F.col("y")).cast("int")).alias("equal_to_label_frac")
    )
    jaccard = ratio(F.col("n11"), F.col("n11") + F.col("n10") + F.col("n01"), 0.0)
    binary = F.col("other") == 0
    return t.select("feature", F.when(binary, jaccard).alias("jaccard_vs_label"), F.when(binary, phi_of(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00"))).alias("phi_vs_label"), "equal_to_label_frac")


def missingness_auc(long: DataFrame) -> DataFrame:
    """feature, auc of whether x is missing."""
    return metrics.auc(missing_flags(long), ["feature"]).select("feature", "auc")


def fold_auc(long: DataFrame, folds: DataFrame) -> DataFrame:
    """feature, oof_auc: the mean over folds of the AUC within each. folds: row_id, fold."""
    return metrics.auc(long.join(folds.select("row_id", "fold"), "row_id"), ["feature", "fold"]).groupBy("feature").agg(F.avg("auc").alias("oof_auc"))


def leakage_audit(long: DataFrame, s: Settings = DEFAULTS, folds: DataFrame | None = None) -> DataFrame:
    """feature with auc, mi, iv, ks, agreement with the label, whether it is suspicious, and why. long: row_id, y, feature, x.

    long is made once: all five statistics read the written rows, and information and IV the same bins.
    """
    long = written(long.select("row_id", "y", "feature", "x"), "audit")
    binned = written(digitize(long, s.bins).select("y", "feature", "x", "bin"), "audit-bins")
    out = metrics.auc(long, ["feature"]).select("feature", "auc")
    parts = [binned_mutual_info(long, s.bins, binned), information_value(woe_half(crosstab(binned))), metrics.ks_grid(long, ["feature"], s.ks_points), against_label(long)]
    if folds is not None:
        parts.append(fold_auc(long, folds))
    for p in parts:
        out = out.join(p, "feature", "left")
    t = s.suspicion
    extreme = lambda c: (F.col(c) >= t["auc"]) | (F.col(c) <= 1 - t["auc"])
    tests = [
        ("single_feature_auc", extreme("auc")), ("high_mi", F.col("mi") >= t["mi"]), ("high_iv", F.col("iv") >= t["iv"]), ("high_ks", F.col("ks") >= t["ks"]),
        ("jaccard_high", F.col("jaccard_vs_label") >= t["jaccard"]), ("phi_high", F.abs("phi_vs_label") >= t["phi"]),
    ]
    suspicious = F.lit(False)
    for _, c in tests:
        suspicious = suspicious | F.coalesce(c, F.lit(False))
    more = [("exactish_match", F.col("equal_to_label_frac") >= s.exact_match)] + ([("oof_auc_confirms", extreme("oof_auc"))] if folds is not None else [])
    reasons = F.concat_ws(";", *(F.when(c, F.lit(n)) for n, c in tests + more))
    return out.withColumns({"is_suspicious": suspicious, "flag_reasons": reasons})
