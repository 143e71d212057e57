"""Predicates on names and descriptions, against answers written down by hand."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import patterns as P
from riskloom.operators import profile


def hits(spark, values, test):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return {values[r["i"]]: r["x"] for r in df.select("i", test(F.col("t")).alias("x")).collect()}


YES = {
    P.is_outcome_like: ["write off flag", "write-off", "chargeoff", "npa", "loan default", "30 dpd", "overlimit", "over-limit", "over due", "past due", "arrears", "min_due", "missed emi", "declined", "rejection", "insufficient funds", "penalty", "bounced", "ecs", "nach", "mission", "inpatient", "spinach", "specs", "negative_balance"],
    P.is_lifetime: ["ever late", "lifetime spend", "life time value", "since inception"],
    P.is_time_like: ["order_month", "ts", "date of birth", "asof_dt", "report-date", "x_year", "hour"],
    P.is_strict_label: ["ever 90 dpd", "default", "bad", "repossessed", "settle", "good outcome"],
    P.is_pii_like: ["customer number", "mobile no", "user id", "token", "email address", "passport"],
    P.has_leak_token: ["max_dpd", "default_rate", "badge", "collections"],
}
NO = {
    P.is_outcome_like: ["paid", "spend last 3 months", "balance", "due date", "minimum"],
    P.is_lifetime: ["never", "several", "ever_late", "everyday"],
    P.is_time_like: ["order_date", "l_shipdate", "days_since_order_month", "tenure in month", "last 3 months of ts", "update"],
    P.is_strict_label: ["bad debtors", "default in app", "defaulting on email", "badly", "campaign default"],
    P.is_pii_like: ["balance", "paid", "spending", "customer_number"],
    P.has_leak_token: ["balance", "income"],
}


@pytest.mark.parametrize("test", list(YES), ids=lambda f: f.__name__)
def test_what_a_predicate_takes_and_leaves(spark, test):
    assert [v for v, x in hits(spark, YES[test], test).items() if not x] == []
    assert [v for v, x in hits(spark, NO[test], test).items() if x] == []


def test_windows(spark):
    want = {"spend last 1 month": "1m", "x 30d": "1m", "spend last 3 months": "3m", "amount 90d": "3m", "6m sum": "6m", "last 6month": "6m", "1 year total": "12m", "360d": "12m", "ever": "lt", "x_3m": "unknown", "last 4 months": "unknown", "last 3 months ever": "3m"}
    assert hits(spark, list(want), P.window_tag) == want
    assert hits(spark, ["last 3 months", "last 3 month"], lambda t: P.window_tag(t, compat=True)) == {"last 3 months": "unknown", "last 3 month": "3m"}


def test_families_ids_scores_and_kinds(spark):
    assert hits(spark, ["var101022", "VAR207", "spend_a", "plain"], P.family) == {"var101022": "var101", "VAR207": "var207", "spend_a": "spend", "plain": "plain"}
    assert hits(spark, ["user_id", "panel", "idle", "lead_count", "mobile_no", "paid", "grid", "custkey"], P.is_id_like) == {"user_id": True, "panel": True, "idle": True, "lead_count": True, "mobile_no": True, "paid": False, "grid": False, "custkey": False}
    scores = {"loan default": 0.95, "writeoff amount": 1.0, "90 dpd": 0.9, "60dpd": 0.75, "30-dpd": 0.6, "missed emi": 0.75, "over limit": 0.6, "fraud": 0.1, "declined": 0.5, "default on order": 0.0, "income": 0.0}
    assert hits(spark, list(scores), P.outcome_score) == scores
    kinds = {"default on order": "excluded", "missed emi": "keyword_weighted", "income": "none"}
    assert hits(spark, list(kinds), P.outcome_type) == kinds
    counts = {"default and overdue": 2, "over limit penalty missed": 3, "income": 0}
    assert hits(spark, list(counts), P.negative_count) == counts
    numeric = {"txn_cnt": "count", "number of visits": "count", "utilization": "ratio", "corporate": "ratio", "loan amount": "amount", "age": "other"}
    assert hits(spark, list(numeric), P.numeric_kind) == numeric


def test_kinds_by_values(spark):
    rows = [("a", float(i)) for i in range(50)] + [("b", i / 100) for i in range(-50, 50)] + [("c", 100.5 * i) for i in range(-20, 20)] + [("d", None), ("e", 3.5), ("e", float("nan"))] + [("income", float(i)) for i in range(9)]
    long = spark.createDataFrame([(i, f, x) for i, (f, x) in enumerate(rows)], "row_id bigint, feature string, x double")
    words = spark.createDataFrame([("income", "income")], "feature string, t string")
    got = {r["feature"]: r for r in profile.value_kinds(long, words).collect()}
    assert {f: r["kind"] for f, r in got.items()} == {"a": "count", "b": "ratio", "c": "other", "d": "other", "e": "ratio", "income": "amount"}
    assert got["b"]["non_negative"] == 0.5 and got["d"]["small"] is None and got["e"]["integral"] == 0.0
