"""Predicates on a column's name and description. Patterns are matched in lower case, anywhere, as the method has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, word lists and weights of the credit-risk method.
WINDOWS = {
    "1m": r"\b(last\s*1\s*months?|1m|30d)\b",
    "3m": r"\b(last\s*3\s*months?|3m|90d)\b",
    "6m": r"\b(last\s*6\s*months?|6m|180d)\b",
    "12m": r"\b(last\s*12\s*months?|12m|360d|1\s*year)\b",
    "lt": r"\b(life\s*time|lifetime|ever|since\s*inception)\b",
}
OUTCOME = (
    r"(write[\s-]?off|charge[\s-]?off|npa|default|dpd|over[-\s]?limit|over\s?due|overdue|past.?due|arrear|min[_\s-]?due|mindue|"
    r"miss(?:ed|ing)?|declin\w*|reject\w*|insufficient|penalt\w*|bounc\w*|ecs|nach|negative\w*)"
)
ID_WORDS = {
    "framework": r"id|uuid|pan|aadhaar|account|acct|application|app(?:lication)?id|lead|mobile(_?no)?|phone|msisdn|email(_?address|_?id)?",
    "snapshot": r"id|uuid|pan|aadhaar|account|application|app(?:lication)?id|lead|mobile|phone|msisdn|email(_?address|_?id)?",
}
PII = (
    r"\b(id|uuid|guid|token|hash)\b",
    r"(application|customer|client|account|loan|case|lead|user|pan|aadhaar|ssn|passport|voter|driver|licen[cs]e|dl|mobile|phone|email|address)\s*(number|id|no|#)?\b",
)
TIME_LIKE = (
    r"((refdate|asof|snapshot|pull|report|run)[-_]?(date|dt))|\b(date|datetime|timestamp|time|ts)\b|"
    r"(^|_)(dow|weekday|week|woy|month|q(uarter)?|year|yr|day|hour|min(ute)?|sec(ond)?)(_|$)"
)
TIME_LAG = r"(since|lag|delta|diff|tenure|vintage|age)"
KEYWORD_WEIGHTS = {
    r"(writeoff|charge.?off|npa|bankruptcy|foreclosure|repossession)": 1.00,
    r"\bdefault(s|ed|ing)?\b": 0.95,
    r"\b90.?dpd\b": 0.90,
    r"\b60.?dpd\b": 0.75,
    r"\b30.?dpd\b": 0.60,
    r"(over\s?due|overdue|past.?due|arrear|miss(?:ed|ing)?|min[_\s-]?due|mindue)": 0.75,
    r"over[-\s]?limit": 0.60,
    r"(negative\w*|noofnegativeevents)": 0.60,
    r"(declin\w*|reject\w*|insufficient|penalt\w*|bounced|nsf|chargeback)": 0.50,
    r"(fraud|suspicious|aml|kyc.?fail|block|freeze)": 0.10,
}
EXCLUDED = (
    "campaign channel device browser ip session click view visit engagement preference transaction transactions purchase purchases booking "
    "bookings recharge recharges order orders site sites imps neft upi wallet travel hotel food grocery entertainment"
).split() + ["credit transactions", "debit transactions", "market place"]
NEGATIVE = (
    r"over[-\s]?limit", r"default|defaults", r"declin\w*", r"reject\w*", r"insufficient", r"penalt\w*", r"miss(?:ed|ing)?", r"over\s?due|overdue",
    r"min[_\s-]?due|mindue", r"negative\w*|noofnegativeevents",
)
STRICT_OUTCOME = (
    r"\bdefault(s|ed|ing)?\b|\bdpd\b|\b(\d+)\s*dpd\b|\bever[_\s-]?(\d+)\s*dpd\b|\bdelinquen|\boverdue\b|\barrear|charge[\s-]?off|write[\s-]?off|"
    r"\bnpa\b|\bsettled?\b|\brepossess|\bforeclos|\bbad\b(?!\s*debtors?)|\bgood\b\s*outcome"
)
STRICT_EXCLUDED = r"\bgambl|\bemail\b|\bdevice\b|\bios\b|\bapp\b|\bcampaign\b|\bchannel\b|\blifetime\b(?!\s*default|dpd|npa|write[-\s]?off)"
LEAK_TOKENS = "dpd default chargeoff writeoff settled overdue npa bad repossession foreclosure bounced nsf collection".split()
NUMERIC_KINDS = {
    "count": ["count", "no.", "num", "times", "frequency", "txn_cnt", "#", "occurrence", "instances"],
    "ratio": ["ratio", "rate", "pct", "percent", "utilization", "dti", "share", "proportion"],
    "amount": ["amount", "amt", "balance", "outstanding", "income", "expense", "bill", "limit", "emi", "loan"],
}


def text(name: str = "column_name", description: str = "description") -> Column:
    return F.lower(F.concat_ws(" ", F.col(name), F.coalesce(F.col(description), F.lit(""))))


def window_tag(t: Column, compat: bool = False) -> Column:
    """1m, 3m, 6m, 12m, lt or unknown: the first window whose pattern occurs. compat: without plural months."""
    out = F.lit("unknown")
    for tag, pattern in reversed(WINDOWS.items()):
        out = F.when(t.rlike(pattern.replace("months?", "month") if compat else pattern), tag).otherwise(out)
    return out


def is_window_aggregate(t: Column, compat: bool = False) -> Column:
    return window_tag(t, compat) != "unknown"


def is_lifetime(t: Column) -> Column:
    return t.rlike(WINDOWS["lt"])


def is_outcome_like(t: Column) -> Column:
    return t.rlike(OUTCOME)


def family(name: Column) -> Column:
    """var123 of var123456, else what stands before the first underscore."""
    low = F.lower(name)
    return F.coalesce(F.nullif(F.regexp_extract(low, r"^var(\d{3})", 0), F.lit("")), F.split(low, "_")[0])


def is_id_like(name: Column, dialect: str = "snapshot") -> Column:
    """A word of the list after a start, an underscore or a sign; what follows doesn't matter."""
    return F.lower(name).rlike(rf"(^|[^a-z0-9])({ID_WORDS[dialect]})")


def is_pii_like(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(PII[0]) | low.rlike(PII[1])


def is_time_like(t: Column, compat: bool = False) -> Column:
    return t.rlike(TIME_LIKE) & ~(t.rlike(TIME_LAG) | is_window_aggregate(t, compat))


def is_time_safe(t: Column, forbidden: list[str]) -> Column:
    return ~window_tag(t).isin(*forbidden) if forbidden else F.lit(True)


def outcome_score(t: Column) -> Column:
    """The largest weight of a keyword that occurs; 0 if an excluded word does."""
    found = F.greatest(F.lit(0.0), *(F.when(t.rlike(p), w).otherwise(0.0) for p, w in KEYWORD_WEIGHTS.items()))
    return F.when(t.rlike("|".join(EXCLUDED)), 0.0).otherwise(found)


def outcome_type(t: Column) -> Column:
    return F.when(t.rlike("|".join(EXCLUDED)), "excluded").when(outcome_score(t) > 0, "keyword_weighted").otherwise("none")


def outcome_keywords(t: Column) -> Column:
    return F.when(t.rlike("|".join(EXCLUDED)), "").otherwise(F.concat_ws("; ", *(F.when(t.rlike(p), F.lit(p)) for p in KEYWORD_WEIGHTS)))


def negative_patterns(t: Column) -> Column:
    return F.concat_ws("; ", *(F.when(t.rlike(p), F.lit(p)) for p in NEGATIVE))


def negative_count(t: Column) -> Column:
    return sum((t.rlike(p).cast("int") for p in NEGATIVE), F.lit(0))


def is_strict_label(t: Column) -> Column:
    return t.rlike(STRICT_OUTCOME) & ~t.rlike(STRICT_EXCLUDED)


def has_leak_token(name: Column) -> Column:
    return F.lower(name).rlike("|".join(LEAK_TOKENS))


def contains_any(t: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w)
    return out


def numeric_kind(t: Column, non_negative: Column | None = None, integral: Column | None = None, small: Column | None = None) -> Column:
    """count, ratio, amount or other: by words, else by shares of the values that are non-negative, integral, and within -5 to 5."""
    out = F.lit("other")
    if small is not None:
        out = F.when(small > 0.98, "ratio").otherwise(out)
    if non_negative is not None and integral is not None:
        out = F.when((non_negative > 0.98) & (integral > 0.95), "count").otherwise(out)
    for kind, words in reversed(NUMERIC_KINDS.items()):
        out = F.when(contains_any(t, words), kind).otherwise(out)
    return out


def column_roles(meta: DataFrame, compat: bool = False) -> DataFrame:
    """meta (column_name, description) with every role."""
    t, name = text(), F.col("column_name")
    return meta.select(
        "column_name",
        window_tag(t, compat).alias("window"),
        is_window_aggregate(t, compat).alias("is_window"),
        is_outcome_like(t).alias("is_outcome"),
        is_lifetime(t).alias("is_lifetime"),
        family(name).alias("family"),
        is_id_like(name, "framework").alias("is_id"),
        is_time_like(t, compat).alias("is_time"),
        has_leak_token(name).alias("has_leak_token"),
        is_strict_label(t).alias("is_strict_label"),
        numeric_kind(t).alias("kind"),
    )
