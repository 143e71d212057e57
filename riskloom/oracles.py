"""DuckDB SQL for the registered queries, on the same tables; doubles are rounded to 6 places as the queries do."""

from __future__ import annotations

from . import fixtures as X
from .functions import patterns as P


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


CUM = """t AS (SELECT feature, x, count(*) AS n, sum(y) AS pos FROM lng WHERE x IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT *, sum(n) OVER a AS cn, sum(pos) OVER a AS cp, sum(n) OVER (PARTITION BY feature) AS nt, sum(pos) OVER (PARTITION BY feature) AS n1,
   sum(n) OVER d AS dn, sum(pos) OVER d AS dp FROM t WINDOW a AS (PARTITION BY feature ORDER BY x), d AS (PARTITION BY feature ORDER BY x DESC))"""
AUC = "CASE WHEN max(n1) = 0 OR max(n1) = max(nt) THEN 0.5 ELSE (sum(pos * (cn - n / 2.0::DOUBLE + 0.5)) - max(n1) * (max(n1) + 1) / 2.0::DOUBLE) / (max(n1)::DOUBLE * (max(nt) - max(n1))) END"
PROF = """vc AS (SELECT feature, x, count(*) AS n FROM lng GROUP BY 1, 2),
 pr AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (x IS NOT NULL), 0) AS BIGINT) AS nv, CAST(count(x) AS BIGINT) AS n_unique, coalesce(max(n) FILTER (x IS NOT NULL), 0) AS top,
   coalesce(max(CASE WHEN x NOT IN (0, 1) THEN 1 END), 0) AS other, max(x - floor(x)) AS frac, coalesce(sum(n) FILTER (x > 0), 0) AS np FROM vc GROUP BY 1),
 mo AS (SELECT feature, avg(x) AS mean, var_samp(x) AS variance, stddev_samp(x) AS std, skewness(x) AS skewness, kurtosis(x) AS kurtosis FROM lng GROUP BY 1),
 prof AS (SELECT pr.*, mean, variance, std, skewness, kurtosis, 1 - nv::DOUBLE / n_rows AS missing, top::DOUBLE / n_rows AS dominant_share, n_unique <= 2 AND other = 0 AS is_binary,
   coalesce(frac <= 1e-8, false) AS is_integer_like, np::DOUBLE / n_rows AS positive_rate FROM pr JOIN mo USING (feature))"""
EDGES = """ed AS (SELECT feature, unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q, unnest(quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM lng WHERE x IS NOT NULL GROUP BY feature),
 el AS (SELECT feature, list(e) AS es FROM ed GROUP BY 1)"""
DIG = f"{EDGES}, dg AS (SELECT l.*, CAST(len(list_filter(es, lambda e: e <= x)) AS DOUBLE) AS bin FROM lng l JOIN el USING (feature) WHERE x IS NOT NULL)"
QCUT = f"{EDGES}, un AS (SELECT feature, count(DISTINCT x) AS u FROM lng GROUP BY 1), dg AS (SELECT l.*, CASE WHEN u > 10 THEN CAST(len(list_filter(list_distinct(es), lambda e: e < x)) AS DOUBLE) ELSE x END AS bin FROM lng l JOIN el USING (feature) JOIN un USING (feature) WHERE x IS NOT NULL)"
XT = "xt AS (SELECT feature, bin, count(*) FILTER (y = 0) AS good, count(*) FILTER (y = 1) AS bad FROM dg GROUP BY 1, 2)"
WS = "ws AS (SELECT *, (good + 1e-6) / (sum(good) OVER p + 1e-6) AS g, (bad + 1e-6) / (sum(bad) OVER p + 1e-6) AS b FROM xt WINDOW p AS (PARTITION BY feature))"
HALF = """h AS (SELECT feature, bin, CASE WHEN good = 0 THEN 0.5 ELSE good::DOUBLE END AS good, CASE WHEN bad = 0 THEN 0.5 ELSE bad::DOUBLE END AS bad FROM xt),
 hh AS (SELECT *, good / sum(good) OVER p AS g, bad / sum(bad) OVER p AS b FROM h WINDOW p AS (PARTITION BY feature))"""


def mi(source: str, inner: str) -> str:
    return f"""jn AS (SELECT feature, bin, y, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2, 3),
 jm AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nt, sum(n) OVER (PARTITION BY feature, bin) AS nu, sum(n) OVER (PARTITION BY feature, y) AS nv FROM jn),
 mi AS (SELECT feature, sum(n / nt * ln(n / nt / (nu / nt * (nv / nt) + {inner}) + {inner})) AS mi FROM jm GROUP BY 1)"""


SCORED = f"{X.DOC_SQL}, sc AS (SELECT row_id, y, n_chars AS x FROM doc)"
PLACED = "pl AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(row_id || '|42'), row_id) AS place, count(*) OVER (PARTITION BY y) AS n FROM doc)"
JOINT = """w AS (SELECT a.source AS a, b.source AS b, count(*) AS n, sum(CASE WHEN a.event > 0 AND b.event > 0 THEN 1 ELSE 0 END)::DOUBLE AS n11, sum(CASE WHEN a.event > 0 AND b.event = 0 THEN 1 ELSE 0 END)::DOUBLE AS n10,
  sum(CASE WHEN a.event = 0 AND b.event > 0 THEN 1 ELSE 0 END)::DOUBLE AS n01, sum(CASE WHEN a.event = 0 AND b.event = 0 THEN 1 ELSE 0 END)::DOUBLE AS n00 FROM ev a JOIN ev b ON a.row_id = b.row_id AND a.source < b.source GROUP BY 1, 2)"""


def _mi4(i: str, rows: str, cols: str) -> str:
    return f"CASE WHEN {i} > 0 THEN {i} / n * ln({i} * n / (({rows}) * ({cols}))) ELSE 0 END"


WSC = "wsc AS (SELECT row_id, sum(severity * weight * event) AS wscore FROM ev JOIN srcs USING (source) GROUP BY 1)"
ROBUST = "qt AS (SELECT feature, quantile_cont(x, 0.25) AS q0, quantile_cont(x, 0.5) AS q1, quantile_cont(x, 0.75) AS q2 FROM lng GROUP BY 1)"


def like(pattern: str) -> str:
    return f"regexp_matches(t, '{pattern}')"


def window_sql() -> str:
    return "CASE " + " ".join(f"WHEN {like(p)} THEN '{w}'" for w, p in P.WINDOWS.items()) + " ELSE 'unknown' END"


ID_SQL = {k: f"regexp_matches(lower(column_name), '(^|[^a-z0-9])({w})')" for k, w in P.ID_WORDS.items()}
TIME_SQL = f"({like(P.TIME_LIKE)} AND NOT ({like(P.TIME_LAG)} OR {window_sql()} <> 'unknown'))"
EXCLUDED = like("|".join(P.EXCLUDED))
SCORE = f"CASE WHEN {EXCLUDED} THEN 0.0 ELSE greatest(0.0, " + ", ".join(f"CASE WHEN {like(p)} THEN {w} ELSE 0.0 END" for p, w in P.KEYWORD_WEIGHTS.items()) + ") END"
KINDS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in P.NUMERIC_KINDS.items()) + " ELSE 'other' END"
# RE2 has no look-ahead: the words that may follow are taken out first.
STRICT = f"(regexp_matches(regexp_replace(t, '\\bbad\\b\\s*debtors?', '', 'g'), '{P.STRICT_OUTCOME.replace('(?!' + chr(92) + 's*debtors?)', '')}') AND NOT regexp_matches(t, '\\bgambl|\\bemail\\b|\\bdevice\\b|\\bios\\b|\\bapp\\b|\\bcampaign\\b|\\bchannel\\b|\\blifetime\\b'))"
GUARD = f"""gd AS (SELECT column_name AS c, 3 AS p, 'id_like' AS reason FROM mt WHERE {ID_SQL['snapshot']} UNION ALL SELECT column_name, 5, 'outcome_like_text' FROM mt WHERE {like(P.OUTCOME)}
 UNION ALL SELECT column_name, 6, 'lifetime_window' FROM mt WHERE {like(P.WINDOWS['lt'])} UNION ALL SELECT column_name, 7, 'forbid_windows:lt' FROM mt WHERE {window_sql()} = 'lt'
 UNION ALL SELECT column_name, 8, 'ban_prefixes:refdate_' FROM mt WHERE starts_with(column_name, 'refdate_') UNION ALL SELECT column_name, 9, 'time_like_literal' FROM mt WHERE {TIME_SQL}"""
FIRST = "SELECT c AS \"column\", arg_min(reason, p) AS reason FROM gd GROUP BY 1"
AUCF = f"af AS (SELECT feature, {AUC} AS auc FROM u GROUP BY 1)"
QUALITY = """(CASE WHEN missing > 0.8 THEN 0.1 WHEN missing > 0.5 THEN 0.5 WHEN missing > 0.2 THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN n_unique <= 1 THEN 0.0 WHEN dominant_share > 0.99 THEN 0.2 WHEN dominant_share > 0.95 THEN 0.5 ELSE 1.0 END::DOUBLE
 * CASE WHEN n_unique > 1 AND n_unique::DOUBLE / n_rows < 0.01 THEN 0.8 ELSE 1.0 END::DOUBLE)"""
GRID = "[" + ",".join(f"{i}/49.0::DOUBLE" for i in range(50)) + "]"
KSGRID = """gr AS (SELECT feature, unnest(quantile_cont(x, [""" + ",".join(repr(i / 49) for i in range(50)) + """])) AS g FROM lng WHERE x IS NOT NULL GROUP BY 1),
 kg AS (SELECT feature, max(d) AS ks FROM (SELECT l.feature, g, abs(avg(CASE WHEN x <= g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (y = 1) - avg(CASE WHEN x <= g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (y = 0)) AS d
  FROM lng l JOIN (SELECT DISTINCT * FROM gr) gg USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
ANOVA = """ag AS (SELECT feature, y, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM lng WHERE x IS NOT NULL GROUP BY 1, 2),
 an AS (SELECT feature, CASE WHEN count(*) > 1 AND sum(n * v) > 0 THEN ((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) END AS f FROM ag GROUP BY 1)"""
CANDIDATE_TEXT = "dt(feature, t) AS (VALUES " + ", ".join(f"('{f}', lower('{f} ' || '{{}}'))" for f in X.SNAP_FEATURES) + ")"
RATES = "rt AS (SELECT p.feature, CASE WHEN is_binary OR is_integer_like THEN 0.0 ELSE q END AS event_threshold, CASE WHEN is_binary OR is_integer_like THEN positive_rate ELSE (SELECT count(*) FROM lng l WHERE l.feature = p.feature AND l.x >= q)::DOUBLE / n_rows END AS event_positive_rate FROM prof p JOIN (SELECT feature, quantile_cont(x, 0.95) AS q FROM lng GROUP BY 1) USING (feature))"
STAT_FOLD = f"{X.DOCLONG_SQL}, {PLACED}, fl AS (SELECT row_id, (place - 1) % 5 AS fold FROM pl), t AS (SELECT feature, fold, x, count(*) AS n, sum(y) AS pos FROM lng JOIN fl USING (row_id) GROUP BY 1, 2, 3), u AS (SELECT *, sum(n) OVER (PARTITION BY feature, fold ORDER BY x) AS cn, sum(n) OVER (PARTITION BY feature, fold) AS nt, sum(pos) OVER (PARTITION BY feature, fold) AS n1 FROM t)"
IMPUTED = "md AS (SELECT feature, median(x) AS md FROM lng GROUP BY 1), lng2 AS (SELECT row_id, y, feature, coalesce(x, md, 0) AS x FROM lng JOIN md USING (feature))"

ORACLES: dict[str, str] = {
    "auc_gini_ks": f"WITH {X.DOCLONG_SQL}, {CUM} SELECT feature, {r(AUC, 'auc')}, {r(f'2 * ({AUC}) - 1', 'gini')}, {r('greatest(0, max(dp::DOUBLE / n1 - (dn - dp)::DOUBLE / (nt - n1)))', 'ks')} FROM u GROUP BY 1",
    "average_precision": f"WITH {X.DOCLONG_SQL}, {CUM} SELECT feature, {r('sum(dp::DOUBLE / dn * pos / n1)', 'ap')} FROM u GROUP BY 1",
    "decile_table": f"""WITH {SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY x, row_id) AS rn, count(*) OVER () AS nt FROM sc),
 b AS (SELECT 11 - CAST(greatest(1, ceil((rn - 1) * 10 / (nt - 1)::DOUBLE)) AS INT) AS decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, avg(x) AS avg_p FROM p GROUP BY 1)
 SELECT decile, n, pos, {r('avg_p', 'avg_p')}, n - pos AS neg, {r('pos::DOUBLE / n', 'pos_rate')}, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(n - pos) OVER w AS BIGINT) AS cum_neg,
 {r('sum(pos) OVER w::DOUBLE / sum(pos) OVER ()', 'cum_pos_capture').replace('OVER w::DOUBLE', 'OVER w * 1.0::DOUBLE')}, {r('sum(n - pos) OVER w * 1.0::DOUBLE / sum(n - pos) OVER ()', 'cum_neg_share')},
 {r('(pos::DOUBLE / n) / (sum(pos) OVER () * 1.0::DOUBLE / sum(n) OVER ())', 'lift')} FROM b WINDOW w AS (ORDER BY decile DESC)""",
    "deciles_v2": f"""WITH {SCORED}, p AS (SELECT *, row_number() OVER (ORDER BY x DESC, row_id) AS rn, count(*) OVER () AS nt FROM sc), g AS (SELECT unnest(range(1, 11)) AS d)
 SELECT CAST(d AS INT) AS decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r('avg(y)', 'rate')}, {r('min(x)', 'score_min')}, {r('max(x)', 'score_max')}, {r('avg(x)', 'score_mean')}
 FROM p, g WHERE floor(nt * (d - 1) / 10.0) < rn AND rn <= floor(nt * d / 10.0) GROUP BY 1""",
    "ks_rowwise": f"""WITH {X.DOCLONG_SQL}, w AS (SELECT feature, sum(y) OVER o::DOUBLE AS z FROM lng WINDOW o AS (PARTITION BY feature ORDER BY x, row_id ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT feature, abs(sum(y) OVER o * 1.0::DOUBLE / sum(y) OVER f - sum(1 - y) OVER o * 1.0::DOUBLE / sum(1 - y) OVER f) AS d FROM lng WINDOW o AS (PARTITION BY feature ORDER BY x, row_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature))
 SELECT feature, {r('max(d)', 'ks')} FROM c GROUP BY 1""".replace("w AS (SELECT feature, sum(y) OVER o::DOUBLE AS z FROM lng WINDOW o AS (PARTITION BY feature ORDER BY x, row_id ROWS UNBOUNDED PRECEDING)),\n ", ""),
    "ks_grid": f"WITH {X.DOCLONG_SQL}, {KSGRID} SELECT feature, {r('ks', 'ks')} FROM kg",
    "brier_logloss": f"WITH {SCORED}, p AS (SELECT y, least(x / 20000, 1.0) AS p FROM sc), c AS (SELECT y, p, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM p) SELECT {r('avg((p - y) * (p - y))', 'brier')}, {r('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))', 'logloss')} FROM c",
    "column_profile": f"WITH {X.SNAPLONG_SQL}, {PROF} SELECT feature, n_rows, {r('missing', 'missing')}, n_unique, {r('dominant_share', 'dominant_share')}, {r('mean', 'mean')}, {r('std', 'std')}, {r('skewness', 'skewness')}, {r('kurtosis', 'kurtosis')}, is_binary, is_integer_like, {r('lo', 'min')}, {r('hi', 'max')}, {r('variance', 'variance')}, {r('positive_rate', 'positive_rate')} FROM prof JOIN (SELECT feature, min(x) AS lo, max(x) AS hi FROM lng GROUP BY 1) USING (feature)",
    "fill_rate_filter": f"WITH {X.SNAPLONG_SQL} SELECT feature, {r('count(x)::DOUBLE / count(*)', 'fill_rate')} FROM lng GROUP BY 1 HAVING count(x)::DOUBLE / count(*) >= 0.85",
    "value_counts_dominant": f"WITH {X.SNAPLONG_SQL} SELECT feature, x, count(*) AS n, {r('count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY feature)', 'share')} FROM lng WHERE x IS NOT NULL GROUP BY 1, 2",
    "column_filters": f"WITH {X.SNAPLONG_SQL}, {PROF} SELECT feature, missing > 0.98 AS hard_missing, dominant_share >= 0.999 AS near_constant, coalesce(variance, 0) <= 1e-8 AS low_variance, coalesce(std, 0) <= 1e-12 AS constant_feature FROM prof",
    "quality_score": f"WITH {X.SNAPLONG_SQL}, {PROF} SELECT feature, {r(QUALITY, 'quality')}, {QUALITY} > 0.3 AND missing < 0.9 AS usable FROM prof",
    "event_rates": f"WITH {X.SNAPLONG_SQL}, {PROF}, {RATES} SELECT feature, {r('event_threshold', 'event_threshold')}, {r('event_positive_rate', 'event_positive_rate')} FROM rt",
    "near_unique": """WITH o AS (SELECT 'o_orderkey' AS feature, o_orderkey::DOUBLE AS x FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders UNION ALL SELECT 'big', o_orderkey + 20000000 FROM orders),
 g AS (SELECT feature, count(*) AS n, count(DISTINCT x) AS u, max(abs(x)) AS m FROM o GROUP BY 1), c AS (SELECT 'c_name' AS feature, c_name AS s FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)
 SELECT feature, 'strict' AS rule FROM g WHERE u >= 0.98 * n UNION ALL SELECT feature, 'large' FROM g WHERE u >= 0.98 * n AND m > 1e7
 UNION ALL SELECT feature, 'string' FROM c GROUP BY 1 HAVING count(DISTINCT s) >= 0.98 * count(*) OR avg(CASE WHEN regexp_matches(s, '^[0-9a-fA-F\\-]{8,}$') THEN 1 ELSE 0 END) > 0.95""",
    "sanity_counts": f"WITH {X.SNAPLONG_SQL} SELECT count(*) // 10 AS n_rows, CAST(10 AS BIGINT) AS n_columns, count(*) - count(x) AS n_missing, CAST(0 AS BIGINT) AS n_infinite FROM lng",
    "histogram": f"WITH {X.SNAPLONG_SQL}, e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM lng GROUP BY 1) SELECT feature, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 20)), 19) END AS INT) AS bin, count(*) AS n FROM lng JOIN e USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2",
    "sample_rows": "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '|42'), c_custkey LIMIT 100",
    "missingness_auc": f"WITH {X.SNAP_SQL}, lng AS (SELECT feature || '__isna' AS feature, y, CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM ({X._union('snap', X.SNAP_FEATURES, 'row_id, y')})), {CUM} SELECT feature, {r(AUC, 'auc')} FROM u GROUP BY 1",
    "column_roles": f"WITH {X.META_SQL} SELECT column_name, {window_sql()} AS \"window\", {window_sql()} <> 'unknown' AS is_window, {like(P.OUTCOME)} AS is_outcome, {like(P.WINDOWS['lt'])} AS is_lifetime, coalesce(nullif(regexp_extract(lower(column_name), '^var(\\d{{3}})'), ''), string_split(lower(column_name), '_')[1]) AS family, {ID_SQL['framework']} AS is_id, {TIME_SQL} AS is_time, regexp_matches(lower(column_name), '{'|'.join(P.LEAK_TOKENS)}') AS has_leak_token, {STRICT} AS is_strict_label, {KINDS} AS kind FROM mt",
    "outcome_score": f"WITH {X.META_SQL} SELECT column_name, {r(f'({SCORE})::DOUBLE', 'outcome_score')}, CASE WHEN {EXCLUDED} THEN 'excluded' WHEN {SCORE} > 0 THEN 'keyword_weighted' ELSE 'none' END AS outcome_type, CAST({' + '.join(f'CAST({like(p)} AS INT)' for p in P.NEGATIVE)} AS INT) AS pattern_count, regexp_matches(lower(column_name), '{P.PII[0]}') OR regexp_matches(lower(column_name), '{P.PII[1]}') AS is_pii FROM mt",
    "coerce_values": f"""WITH c AS (SELECT c_custkey, ['Yes ', 'n', '3', '1', 'TRUE', 'f'][c_custkey % 6 + 1] AS w, c_acctbal AS x FROM customer)
 SELECT c_custkey, CASE WHEN lower(trim(w)) IN ('true', 'yes', 'y', 't', '1') THEN 1.0::DOUBLE WHEN lower(trim(w)) IN ('false', 'no', 'n', 'f', '0') THEN 0.0::DOUBLE END AS dialect_1, CASE WHEN lower(w) IN ('true', 'yes', 'y') THEN 1.0::DOUBLE WHEN lower(w) IN ('false', 'no', 'n') THEN 0.0::DOUBLE END AS dialect_2,
 CASE WHEN lower(w) IN ('true', 'yes', 'y') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS boolified, {r('ln(1 + greatest(x, 0))', 'sev_log1p')}, {r('asinh(greatest(x, 0))', 'sev_asinh')}, {r('asinh(x)', 'sev_signed_asinh')}, {r('least(greatest(x, 0), 10)', 'sev_cap')}, {r('x', 'sev_raw')} FROM c""",
    "binary_pairs": f"WITH {X.EVENTS_SQL}, {JOINT} SELECT a, b, {r('CASE WHEN n11 + n10 + n01 = 0 THEN 0 ELSE n11 / (n11 + n10 + n01) END', 'jaccard')}, {r('CASE WHEN (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00) = 0 THEN 0 ELSE (n11 * n00 - n10 * n01) / sqrt((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)) END', 'phi')}, "
    + r(" + ".join([_mi4("n11", "n11 + n10", "n11 + n01"), _mi4("n10", "n11 + n10", "n10 + n00"), _mi4("n01", "n01 + n00", "n11 + n01"), _mi4("n00", "n01 + n00", "n10 + n00")]), "mutual_info") + " FROM w",
    "pearson_pairs": f"WITH {X.SNAPLONG_SQL} SELECT a.feature AS a, b.feature AS b, count(*) AS n, {r('CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) END', 'r')} FROM lng a JOIN lng b ON a.row_id = b.row_id AND a.feature < b.feature WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2",
    "spearman_pairs": f"WITH {X.SNAPLONG_SQL}, rk AS (SELECT row_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS x FROM lng WHERE x IS NOT NULL) SELECT a.feature AS a, b.feature AS b, count(*) AS n, {r('covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x))', 'r')} FROM rk a JOIN rk b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY 1, 2",
    "anova_f": f"WITH {X.SNAPLONG_SQL}, {ANOVA} SELECT feature, {r('f', 'f')} FROM an",
    "mi_binned": f"WITH {X.DOCLONG_SQL}, {DIG}, kd AS (SELECT feature, count(DISTINCT x) > 10 AND max(abs(x - floor(x))) > 0 AS k FROM lng GROUP BY 1), bn AS (SELECT d.feature, d.y, CASE WHEN k THEN bin ELSE x END AS bin FROM dg d JOIN kd USING (feature)), {mi('bn', '1e-12')} SELECT feature, {r('mi', 'mi')} FROM mi",
    "mi_kbins": f"WITH {X.SNAPLONG_SQL}, {IMPUTED}, {DIG.replace('FROM lng', 'FROM lng2')}, {mi('dg', '0')} SELECT feature, {r('mi', 'mi')} FROM mi",
    "woe_table": f"WITH {X.DOCLONG_SQL}, {QCUT}, {XT}, {WS} SELECT feature, {r('bin', 'bin')}, good, bad, {r('ln(g / b)', 'woe')}, {r('(g - b) * ln(g / b)', 'iv_part')} FROM ws",
    "iv_qcut": f"WITH {X.DOCLONG_SQL}, {QCUT}, {XT}, {WS} SELECT feature, {r('sum((g - b) * ln(g / b))', 'iv')} FROM ws GROUP BY 1",
    "iv_digitize": f"WITH {X.DOCLONG_SQL}, {DIG}, {XT}, {HALF} SELECT feature, {r('sum((b - g) * ln(least(greatest(b / g, 1e-6), 1e6)))', 'iv')} FROM hh GROUP BY 1",
    "woe_categorical": f"WITH {X.DOC_SQL}, lv AS (SELECT 'source' AS feature, source AS l, y FROM doc UNION ALL SELECT 'lang', lang, y FROM doc), kp AS (SELECT feature, l FROM lv GROUP BY 1, 2 HAVING count(*) >= 20), dg AS (SELECT lv.feature, CASE WHEN kp.l IS NULL THEN '__OTHER__' ELSE lv.l END AS bin, y FROM lv LEFT JOIN kp ON lv.feature = kp.feature AND lv.l = kp.l), {XT}, {WS} SELECT feature, bin, good, bad, {r('ln(g / b)', 'woe')}, {r('(g - b) * ln(g / b)', 'iv_part')} FROM ws",
    "rare_collapse": f"WITH {X.SNAP_SQL}, k AS (SELECT nation, count(*) AS n FROM snap GROUP BY 1) SELECT CASE WHEN n >= 60 THEN nation ELSE '__OTHER__' END AS nation, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1",
    "label_union": f"WITH {X.EVENTS_SQL} SELECT row_id, max(event) AS label_union, CAST(sum(event) AS BIGINT) AS n_sources, min(CASE WHEN event = 1 THEN source END) AS first_source FROM ev GROUP BY 1",
    "label_histogram": f"WITH {X.EVENTS_SQL} SELECT n_sources, count(*) AS n_rows FROM (SELECT row_id, CAST(sum(event) AS BIGINT) AS n_sources FROM ev GROUP BY 1) GROUP BY 1",
    "label_contribution": f"WITH {X.EVENTS_SQL}, p AS (SELECT row_id FROM ev GROUP BY 1 HAVING max(event) = 1) SELECT source, {r('avg(event) FILTER (row_id IN (SELECT row_id FROM p))', 'share')}, {r('avg(event)', 'prevalence')} FROM ev GROUP BY 1",
    "label_weighted": f"WITH {X.EVENTS_SQL}, {WSC}, q AS (SELECT quantile_cont(wscore, 0.9) AS q FROM wsc WHERE wscore > 0) SELECT row_id, {r('wscore', 'wscore')}, CASE WHEN wscore > 0 AND wscore >= q THEN 1 ELSE 0 END AS label_weighted FROM wsc, q",
    "label_threshold_sweep": f"WITH {X.EVENTS_SQL}, {WSC}, th AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5]::DOUBLE[]) AS threshold) SELECT threshold, {r('avg(CASE WHEN wscore >= threshold THEN 1 ELSE 0 END)', 'positive_rate')} FROM wsc, th GROUP BY 1",
    "label_per_source": f"WITH {X.EVENTS_SQL} SELECT row_id, max(CASE WHEN source = 'neg_balance' THEN event ELSE 0 END) AS label_neg_balance FROM ev GROUP BY 1",
    "risk_score": f"""WITH {X.EVENTS_SQL}, q AS (SELECT source, quantile_cont(severity, 0.5) AS lo, quantile_cont(severity, 0.995) AS hi, avg(event) AS pi FROM ev GROUP BY 1),
 f AS (SELECT q.*, weight * CASE win WHEN '1m' THEN 1.0 WHEN '3m' THEN 0.95 WHEN '6m' THEN 0.9 WHEN '12m' THEN 0.85 WHEN 'lt' THEN 0.8 ELSE 0.9 END::DOUBLE * least(1 / sqrt(greatest(pi, 1e-3)), 8.0) AS factor FROM q JOIN srcs USING (source)),
 z AS (SELECT row_id, round(sum(CASE WHEN hi > lo THEN least(1, greatest(0, (severity - lo) / (hi - lo))) ELSE 0 END * factor), 9) AS raw FROM ev JOIN f USING (source) GROUP BY 1),
 k AS (SELECT row_id, raw, (rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2.0::DOUBLE) / count(*) OVER () AS p FROM z)
 SELECT row_id, {r('raw', 'risk_score_raw')}, {r('p', 'risk_percentile')}, round(round_even(100 * p, 2), 6) AS risk_score_0_100 FROM k""",
    "label_candidates": "",
    "negative_patterns": "",
    "guard_reasons": f"WITH {X.META_SQL}, {GUARD} UNION ALL SELECT unnest(['paid', 'ts']), 0, 'external_guard_list') {FIRST}",
    "guard_framework": f"WITH {X.META_SQL}, fm AS (SELECT column_name, t, coalesce(nullif(regexp_extract(lower(column_name), '^var(\\d{{3}})'), ''), string_split(lower(column_name), '_')[1]) AS fam FROM mt) SELECT DISTINCT column_name AS \"column\" FROM fm WHERE column_name IN ('var101022', 'spend_a') OR fam IN (SELECT fam FROM fm WHERE column_name IN ('var101022', 'spend_a')) OR {like(P.OUTCOME)}",
    "guard_counts": f"WITH {X.META_SQL}, {GUARD}) SELECT reason, count(*) AS n_columns FROM ({FIRST}) GROUP BY 1",
    "one_hot": f"WITH {X.DOC_SQL} SELECT row_id, " + ", ".join(f"CASE WHEN lang = '{v}' THEN 1 ELSE 0 END AS lang__is_{v}" for v in ("de", "en", "es", "fr")) + " FROM doc",
    "freq_encode": f"WITH {X.DOC_SQL} SELECT row_id, source, {r('count(*) OVER (PARTITION BY source)::DOUBLE / count(*) OVER ()', 'source__freq').replace('(PARTITION BY source)::DOUBLE', '(PARTITION BY source) * 1.0::DOUBLE')} FROM doc",
    "target_encode_cv": f"WITH {X.DOC_SQL}, {PLACED}, fd AS (SELECT row_id, source, y, CAST((place - 1) % 5 AS INT) AS fold FROM pl), w AS (SELECT *, sum(y) OVER s - sum(y) OVER sf AS ss, count(*) OVER s - count(*) OVER sf AS sc, sum(y) OVER () - sum(y) OVER f AS ts, count(*) OVER () - count(*) OVER f AS tc FROM fd WINDOW s AS (PARTITION BY source), sf AS (PARTITION BY source, fold), f AS (PARTITION BY fold)) SELECT row_id, source, fold, {r('CASE WHEN sc > 0 THEN ss::DOUBLE / sc ELSE ts::DOUBLE / tc END', 'source__te')} FROM w",
    "impute_scale": f"WITH {X.SNAPLONG_SQL}, {IMPUTED}, {ROBUST.replace('FROM lng', 'FROM lng2')} SELECT feature, row_id, {r('(x - q1) / CASE WHEN q2 - q0 = 0 THEN 1 ELSE q2 - q0 END', 'x')} FROM lng2 JOIN qt USING (feature)",
    "numeric_transform": f"WITH {X.SNAPLONG_SQL}, m AS (SELECT feature, min(x) AS m FROM lng GROUP BY 1) SELECT feature, row_id, {r("CASE WHEN starts_with(feature, 'n_') THEN ln(1 + x + CASE WHEN m < 0 THEN -m ELSE 0 END) ELSE asinh(x) END", 'x')} FROM lng JOIN m USING (feature)",
    "standard_scale": f"WITH {X.SNAPLONG_SQL}, m AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM lng GROUP BY 1) SELECT feature, row_id, {r('coalesce((x - m) / CASE WHEN coalesce(s, 0) = 0 THEN 1 ELSE s END, 0)', 'x')} FROM lng JOIN m USING (feature)",
    "winsorise": f"WITH {X.SNAPLONG_SQL}, q AS (SELECT feature, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM lng GROUP BY 1) SELECT feature, row_id, {r('CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END', 'x')} FROM lng JOIN q USING (feature)",
    "sanitise": f"WITH {X.SNAPLONG_SQL}, {IMPUTED} SELECT feature, count(x) AS n, {r('avg(x)', 'mean')} FROM lng2 GROUP BY 1 HAVING stddev_samp(x) > 1e-12",
    "fold_auc": f"WITH {STAT_FOLD}, fa AS (SELECT feature, fold, {AUC} AS auc FROM u GROUP BY 1, 2) SELECT feature, {r('avg(auc)', 'oof_auc')} FROM fa GROUP BY 1",
    "stratified_split": f"WITH {X.DOC_SQL}, {PLACED} SELECT row_id, y, CASE WHEN (place - 1)::DOUBLE / n < 0.7 THEN 'train' WHEN (place - 1)::DOUBLE / n < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM pl",
    "stratified_kfold": f"WITH {X.DOC_SQL}, {PLACED} SELECT row_id, y, CAST((place - 1) % 5 AS INT) AS fold FROM pl",
    "alignment_check": "SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_right",
    "event_rate_windows": "SELECT strftime(to_timestamp(floor(epoch(ts) / 2592000) * 2592000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3",
    "leakage_audit": f"""WITH {X.DOCLONG_SQL}, {CUM}, {AUCF}, {DIG}, {XT}, {HALF}, {KSGRID}, kd AS (SELECT feature, count(DISTINCT x) > 10 AND max(abs(x - floor(x))) > 0 AS k FROM lng GROUP BY 1), bn AS (SELECT d.feature, d.y, CASE WHEN k THEN bin ELSE x END AS bin FROM dg d JOIN kd USING (feature)), {mi('bn', '1e-12')},
 iv AS (SELECT feature, sum((b - g) * ln(least(greatest(b / g, 1e-6), 1e6))) AS iv FROM hh GROUP BY 1), eq AS (SELECT feature, avg(CASE WHEN x = y THEN 1 ELSE 0 END) AS e FROM lng GROUP BY 1)
 SELECT feature, {r('auc', 'auc')}, {r('mi', 'mi')}, {r('iv', 'iv')}, {r('ks', 'ks')}, NULL::DOUBLE AS jaccard_vs_label, NULL::DOUBLE AS phi_vs_label, {r('e', 'equal_to_label_frac')}, auc >= 0.9 OR auc <= 1 - 0.9 OR mi >= 0.2 OR iv >= 1.5 OR ks >= 0.7 AS is_suspicious,
 concat_ws(';', CASE WHEN auc >= 0.9 OR auc <= 1 - 0.9 THEN 'single_feature_auc' END, CASE WHEN mi >= 0.2 THEN 'high_mi' END, CASE WHEN iv >= 1.5 THEN 'high_iv' END, CASE WHEN ks >= 0.7 THEN 'high_ks' END, CASE WHEN e >= 0.995 THEN 'exactish_match' END) AS flag_reasons
 FROM af JOIN mi USING (feature) JOIN iv USING (feature) JOIN kg USING (feature) JOIN eq USING (feature)""",
}

# Candidates and sources of labels.
TEXTS = {"ret_share": "default share", "urgent_share": "missed dues last 3 month", "acctbal": "balance", "n_events": "declined events", "avg_disc": "over limit lifetime"}
TEXT_SQL = "dt(feature, d, t) AS (VALUES " + ", ".join(f"('{f}', '{TEXTS.get(f, '')}', '{(f + ' ' + TEXTS.get(f, '')).lower()}')" for f in X.SNAP_FEATURES) + ")"
NEGATIVES = " + ".join(f"CAST({like(p)} AS INT)" for p in P.NEGATIVE)
CANDIDATES = f"""{TEXT_SQL}, cq AS (SELECT feature AS variable, {window_sql()} AS win, ({SCORE})::DOUBLE AS outcome_score, CASE WHEN n_unique <= 1 THEN 0.0 WHEN missing > 0.8 THEN 0.3 WHEN missing > 0.5 THEN 0.7 ELSE 1.0 END::DOUBLE AS quality_score, event_threshold, event_positive_rate FROM prof JOIN rt USING (feature) JOIN dt USING (feature)),
 cand AS (SELECT *, outcome_score * quality_score AS combined_score, outcome_score >= 0.6 AND quality_score > 0.5 AND event_positive_rate BETWEEN 0.005 AND 0.3 AS eligible FROM cq WHERE win <> 'lt'),
 nq AS (SELECT feature AS variable, {NEGATIVES} AS pattern_count, {window_sql()} AS win, is_binary, is_integer_like, positive_rate, missing, n_unique, is_binary OR is_integer_like AS discrete, positive_rate BETWEEN 0.005 AND 0.3 AS common FROM prof JOIN dt USING (feature)),
 neg AS (SELECT *, CASE WHEN missing < 0.1 THEN 0.4 WHEN missing < 0.3 THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN discrete THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN common THEN 0.3 ELSE 0.0 END::DOUBLE AS priority FROM nq WHERE pattern_count > 0 AND win <> 'lt'),
 rec AS (SELECT *, discrete AND common AND missing < 0.5 AND round(priority, 9) >= 0.6 AS recommended FROM neg),
 src AS (SELECT s.variable AS source, s.weight, s.first, c.event_threshold, c.win FROM (SELECT variable, priority AS weight, true AS first FROM rec WHERE recommended UNION ALL SELECT variable, combined_score, false FROM cand WHERE eligible AND variable NOT IN (SELECT variable FROM rec WHERE recommended)) s LEFT JOIN cand c USING (variable) WHERE coalesce(c.win, 'unknown') <> 'lt')"""
CAND = f"WITH {X.SNAPLONG_SQL}, {PROF}, {RATES}, {CANDIDATES}"
CAND_ROWS = f"variable, win AS \"window\", {r('outcome_score', 'outcome_score')}, {r('quality_score', 'quality_score')}, {r('combined_score', 'combined_score')}, {r('event_threshold', 'event_threshold')}, {r('event_positive_rate', 'event_positive_rate')}, eligible AS eligible_for_label FROM cand"
SRC_ROWS = f"source, {r('weight', 'weight')}, first"

# Scores of features by three methods, for a label of the snapshot.
RANKS = "rk AS (SELECT row_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS x FROM lng WHERE x IS NOT NULL)"
R = "CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0 THEN covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)) END"
PEARSON = f"pc AS (SELECT a.feature AS a, b.feature AS b, {R} AS r FROM lng a JOIN lng b ON a.row_id = b.row_id AND a.feature < b.feature WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2)"
SPEARMAN = f"{RANKS}, pc AS (SELECT a.feature AS a, b.feature AS b, {R} AS r FROM rk a JOIN rk b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY 1, 2)"
WITH_Y = f"{RANKS}, ry AS (SELECT row_id, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS x FROM (SELECT DISTINCT row_id, y FROM lng)), sy AS (SELECT a.feature, {R} AS r FROM rk a JOIN ry b USING (row_id) GROUP BY 1)"
METHODS = f"{ANOVA}, {IMPUTED}, {DIG.replace('FROM lng', 'FROM lng2')}, {mi('dg', '0')}, {WITH_Y}, ms AS (SELECT feature, round(f, 9) AS f, round(abs(r), 9) AS spearman, round(mi, 9) AS mi FROM an LEFT JOIN sy USING (feature) LEFT JOIN mi USING (feature))"
SCORES = f"WITH {X.SNAPLONG_SQL}, {METHODS}"
PART = "coalesce(abs({c}) / nullif(max(abs({c})) OVER ({p}), 0), 0) * {w}"


def rank_of(c: str) -> str:
    return f"(rank() OVER (ORDER BY coalesce({c}, 0) DESC) + (count(*) OVER (PARTITION BY coalesce({c}, 0)) - 1) / 2.0::DOUBLE)"


def greedy(corr: str, test: str, loser: str) -> str:
    """feature, kept after the pairs that pass test are met in order of the later column, then the earlier."""
    return f"""WITH RECURSIVE {X.SNAPLONG_SQL}, {corr}, pos(feature, p) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(X.SNAP_FEATURES))}), cnt AS (SELECT feature, count(x) AS n FROM lng GROUP BY 1),
 ed2 AS (SELECT CASE WHEN pa.p < pb.p THEN a ELSE b END AS early, CASE WHEN pa.p < pb.p THEN b ELSE a END AS late, least(pa.p, pb.p) AS pe, greatest(pa.p, pb.p) AS pl FROM pc JOIN pos pa ON pa.feature = a JOIN pos pb ON pb.feature = b WHERE round(abs(r), 12) {test}),
 ed3 AS (SELECT early, late, {loser} AS loser, row_number() OVER (ORDER BY pl, pe) AS i FROM ed2 JOIN cnt ce ON ce.feature = early JOIN cnt cl ON cl.feature = late),
 go(i, gone) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT ed3.i, CASE WHEN list_contains(gone, early) OR list_contains(gone, late) THEN gone ELSE list_append(gone, loser) END FROM go JOIN ed3 ON ed3.i = go.i + 1)
 SELECT feature, NOT list_contains((SELECT gone FROM go ORDER BY i DESC LIMIT 1), feature) AS kept FROM pos"""


def later(corr: str, test: str) -> str:
    """Columns that correlate with an earlier one."""
    place = "list_position([" + ", ".join(f"'{f}'" for f in X.SNAP_FEATURES) + "], {c})"
    return f"SELECT DISTINCT CASE WHEN {place.format(c='a')} < {place.format(c='b')} THEN b ELSE a END AS feature FROM ({corr}) WHERE round(abs(r), 12) {test}"


def dominance(cutoff: float, floor: float, rounds: int = 5) -> str:
    """Sources left, round by round: heavy ones go as long as the rest keeps the union's prevalence."""
    steps = ["s0 AS (SELECT list(DISTINCT source) AS l FROM ev)"]
    for i in range(rounds):
        steps.append(f"""p{i} AS (SELECT row_id FROM ev, s{i} WHERE list_contains(l, source) GROUP BY 1 HAVING max(event) = 1), h{i} AS (SELECT source FROM ev, s{i} WHERE list_contains(l, source) AND row_id IN (SELECT row_id FROM p{i}) GROUP BY 1 HAVING avg(event) >= {cutoff}),
 hl{i} AS (SELECT coalesce(list(source), []) AS heavy FROM h{i}), r{i} AS (SELECT list_filter(l, lambda x: NOT list_contains(heavy, x)) AS rest, l FROM s{i}, hl{i}),
 u{i} AS (SELECT (SELECT avg(m) FROM (SELECT row_id, max(event) AS m FROM ev, r{i} WHERE list_contains(rest, source) GROUP BY 1)) AS left_over),
 s{i + 1} AS (SELECT CASE WHEN len(rest) = 0 OR len(rest) = len(l) OR left_over < {floor} THEN l ELSE rest END AS l FROM r{i}, u{i})""")
    return f"WITH {X.EVENTS_SQL}, {', '.join(steps)} SELECT unnest(l) AS source FROM s{rounds}"


JACCARD = "CASE WHEN n11 + n10 + n01 = 0 THEN 0 ELSE n11 / (n11 + n10 + n01) END"
PAIRED = " UNION ALL ".join(f"SELECT row_id, '{n}' AS label, {e} AS y FROM snap" for n, e in (("negative", "CASE WHEN acctbal < 0 THEN 1 ELSE 0 END"), ("returns", "y")))
HELD = "hd AS (SELECT row_id FROM pl WHERE (place - 1)::DOUBLE / n < 0.25)"
#: The spreads by label: the CTEs of METHODS with lng as (row_id, y, feature, x) of a label and a feature.
BOTH = f"WITH {X.SNAP_SQL}, lab AS ({PAIRED}), base AS ({X._union('snap', X.SNAP_FEATURES, 'row_id')}), lng AS (SELECT row_id, lab.y, label || '|' || feature AS feature, x FROM base JOIN lab USING (row_id)), {ANOVA}, {IMPUTED}, {DIG.replace('FROM lng', 'FROM lng2')}, {mi('dg', '0')}, {RANKS}, ry AS (SELECT row_id, label, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0::DOUBLE AS x FROM lab), sy AS (SELECT a.feature, {R} AS r FROM rk a JOIN ry b ON a.row_id = b.row_id AND starts_with(a.feature, b.label || '|') GROUP BY 1), ms AS (SELECT string_split(feature, '|')[1] AS label, string_split(feature, '|')[2] AS feature, round(f, 9) AS f, round(abs(r), 9) AS spearman, round(mi, 9) AS mi FROM an LEFT JOIN sy USING (feature) LEFT JOIN mi USING (feature))"
BRIER = "br AS (SELECT avg((x - y) * (x - y)) AS brier, avg(-(y * ln(least(greatest(x, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(x, 1e-15), 1 - 1e-15)))) AS logloss FROM lng)"

ORACLES |= {
    "label_candidates": f"{CAND} SELECT {CAND_ROWS}",
    "label_rescue": f"{CAND} SELECT {CAND_ROWS} WHERE NOT eligible AND outcome_score > 0 AND event_positive_rate BETWEEN 0.002 AND 0.4 ORDER BY cand.combined_score DESC, variable LIMIT 12",
    "negative_patterns": f"{CAND} SELECT variable, CAST(pattern_count AS INT) AS pattern_count, is_binary, is_integer_like, {r('positive_rate', 'event_positive_rate')}, {r('missing', 'missing_pct')}, n_unique, {r('priority', 'priority_score')}, recommended AS recommended_for_label FROM rec",
    "label_sources": f"{CAND} SELECT {SRC_ROWS}, {r('event_threshold', 'event_threshold')}, win AS \"window\" FROM src",
    "label_sources_compat": f"{CAND} SELECT {SRC_ROWS}, CASE WHEN NOT EXISTS (SELECT 1 FROM rec WHERE recommended) THEN {r('event_threshold', 'x')[:-5]} END AS event_threshold, win AS \"window\" FROM src",
    "label_sources_table": f"{CAND} SELECT source AS label_source, {r('weight', 'weight')}, d AS \"desc\", {r('event_threshold', 'event_threshold')}, win AS \"window\" FROM src JOIN dt ON feature = source",
    "binarised_sources": f"{CAND}, ev2 AS (SELECT source, CASE WHEN CASE WHEN event_threshold > 0 THEN x >= event_threshold ELSE x > 0 END THEN 1 ELSE 0 END AS event, ln(1 + greatest(coalesce(x, 0), 0)) AS severity FROM lng JOIN src ON source = feature) SELECT source, CAST(sum(event) AS BIGINT) AS n_events, {r('sum(severity)', 'severity')} FROM ev2 GROUP BY 1 HAVING max(event) > 0",
    "severe_sources": f"WITH {X.EVENTS_SQL}, l AS (SELECT unnest([0.7, 2.0]::DOUBLE[]) AS least), n AS (SELECT source, sum(event) AS n_events FROM ev GROUP BY 1) SELECT least, source, CAST(n_events AS BIGINT) AS n_events FROM srcs JOIN n USING (source), l WHERE weight >= least OR least > (SELECT max(weight) FROM srcs)",
    "severity_auto": f"WITH {X.SNAPLONG_SQL}, e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM lng GROUP BY 1) SELECT row_id, feature, {r('CASE WHEN lo >= 0 THEN CASE WHEN hi <= 1 THEN coalesce(x, 0) ELSE ln(1 + greatest(coalesce(x, 0), 0)) END ELSE asinh(coalesce(x, 0)) END', 'severity')} FROM lng JOIN e USING (feature)",
    "top_dummies": f"WITH {X.DOC_SQL}, c AS (SELECT source, count(*) AS n FROM doc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT 'source__top_' || source AS dummy, n FROM c",
    "fill_zero": f"WITH {X.SNAPLONG_SQL} SELECT row_id, feature, {r('coalesce(x, 0)', 'x')} FROM lng",
    "dominance_prune": dominance(0.45, 0.002),
    "jaccard_dedup": f"""WITH RECURSIVE {X.EVENTS_SQL}, {JOINT}, jd AS (SELECT a, b FROM w WHERE {JACCARD} >= 0.05 UNION ALL SELECT b, a FROM w WHERE {JACCARD} >= 0.05),
 od AS (SELECT source, row_number() OVER (ORDER BY weight DESC, source) AS i, coalesce((SELECT list(b) FROM jd WHERE a = source), []) AS near FROM srcs),
 go(i, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT od.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, source) END FROM go JOIN od ON od.i = go.i + 1) SELECT unnest(kept) AS source FROM go WHERE i = (SELECT max(i) FROM go)""",
    "leak_report": f"""WITH {X.META_SQL}, {X.SNAPLONG_SQL}, {CUM}, {AUCF}, {WITH_Y}, tk AS (SELECT '{'|'.join(P.LEAK_TOKENS)}' AS k)
 SELECT column_name AS "column", 'name_token' AS reason FROM meta, tk WHERE regexp_matches(lower(column_name), k) UNION ALL SELECT column_name, 'description_token' FROM meta, tk WHERE regexp_matches(lower(description), k)
 UNION ALL SELECT feature, 'spearman' FROM sy WHERE abs(r) >= 0.999 UNION ALL SELECT feature, 'single_feature_auc' FROM af WHERE greatest(auc, 1 - auc) >= 0.995""",
    "corr_prune": greedy(PEARSON, ">= 0.8", "early"),
    "corr_prune_strict": greedy(PEARSON, "> 0.8", "CASE WHEN cl.n < ce.n THEN late ELSE early END"),
    "redundant_columns": f"WITH {X.SNAPLONG_SQL}, {SPEARMAN}, {PEARSON.replace('pc AS', 'pp AS')} SELECT 'spearman' AS rule, feature FROM ({later('SELECT * FROM pc', '> 0.8')}) UNION ALL SELECT 'pearson', feature FROM ({later('SELECT * FROM pp', '>= 0.8')})",
    "component_prune": f"""WITH RECURSIVE {X.SNAPLONG_SQL}, {PEARSON}, pos(feature, p) AS (VALUES {', '.join(f"('{f}', {i})" for i, f in enumerate(X.SNAP_FEATURES))}), cnt AS (SELECT feature, count(x) AS n FROM lng GROUP BY 1),
 e2 AS (SELECT a, b FROM pc WHERE round(abs(r), 12) >= 0.8 UNION ALL SELECT b, a FROM pc WHERE round(abs(r), 12) >= 0.8), reach(f, g) AS (SELECT feature, feature FROM pos UNION SELECT f, b FROM reach JOIN e2 ON g = a),
 best AS (SELECT f, g, row_number() OVER (PARTITION BY f ORDER BY n DESC, p) AS k FROM reach JOIN pos ON pos.feature = g JOIN cnt ON cnt.feature = g) SELECT f AS feature, f = g AS kept FROM best WHERE k = 1""",
    "auto_guard": f"WITH {X.META_SQL} SELECT column_name AS \"column\" FROM meta WHERE regexp_matches(lower(column_name), 'flag|default|bad')",
    "verification_guard": f"WITH {X.META_SQL} SELECT DISTINCT column_name AS \"column\" FROM meta WHERE column_name IN ('var207028', 'spend_a') OR regexp_matches(lower(description), 'default|dpd|overdue|writeoff|chargeoff|npa|miss|overlimit|declin|reject|negative|due|penalty')",
    "guard_from_files": "SELECT DISTINCT p_name AS \"column\" FROM part WHERE p_partkey % 4 IN (0, 1) UNION SELECT event_type FROM events UNION SELECT 'hour_' || CAST(hour(ts) AS VARCHAR) FROM events",
    "forbidden_window_columns": f"WITH {X.META_SQL}, w AS (SELECT column_name, {window_sql()} AS win FROM mt) SELECT column_name, win NOT IN (SELECT win FROM w WHERE column_name IN ('spend_a', 'var207028') AND win <> 'unknown') AS safe FROM w",
    "auc_bands": f"WITH {X.SNAPLONG_SQL}, {CUM}, {AUCF} SELECT feature, CASE WHEN auc > 0.95 THEN 'suspicious' WHEN auc > 0.8 THEN 'strong' WHEN auc > 0.6 THEN 'fair' ELSE 'weak' END AS band, CASE WHEN greatest(auc, 1 - auc) > 0.6 THEN true END AS too_predictive FROM af",
    "single_feature_scan": f"WITH {X.DOC_SQL}, {PLACED}, {HELD}, lng AS (SELECT * FROM ({X._union('doc', X.DOC_FEATURES, 'row_id, y')}) WHERE row_id IN (SELECT row_id FROM hd)), {CUM}, {AUCF} SELECT feature, {r('greatest(auc, 1 - auc)', 'single_feature_auc')} FROM af",
    "combined_score": f"{SCORES} SELECT feature, round({' + '.join(PART.format(c=c, p='', w=w) for c, w in (('mi', 0.30), ('f', 0.25), ('spearman', 0.25)))}, 6) AS score FROM ms",
    "per_label_scores": f"{BOTH} SELECT label, feature, {r('f', 'f')}, {r('spearman', 'spearman')}, {r('mi', 'mi')}, round({' + '.join(PART.format(c=c, p='PARTITION BY label', w=w) for c, w in (('mi', 0.30), ('f', 0.25), ('spearman', 0.25)))}, 6) AS score FROM ms",
    "consensus_rank": f"{SCORES} SELECT feature, {', '.join(r(f'coalesce({c}, 0)', c) for c in ('f', 'spearman', 'mi'))}, {', '.join(f'{rank_of(c)} AS rank_{c}' for c in ('f', 'spearman', 'mi'))}, round(({' + '.join(map(rank_of, ('f', 'spearman', 'mi')))}) / 3, 6) AS consensus_rank FROM ms",
    "importance_matrix": f"{SCORES} SELECT feature, round(CASE WHEN spearman > 0.01 THEN spearman ELSE 0 END, 6) AS spearman, round(CASE WHEN mi > 0.01 THEN mi ELSE 0 END, 6) AS mi, round((CASE WHEN spearman > 0.01 THEN spearman ELSE 0 END + CASE WHEN mi > 0.01 THEN mi ELSE 0 END) / 2, 6) AS mean_score FROM ms WHERE spearman > 0.01 OR mi > 0.01",
    "top_features": f"{SCORES} SELECT feature, {r('mi', 'mi')} FROM ms ORDER BY ms.mi DESC, feature LIMIT 3",
    "bar_chart": f"{SCORES} SELECT feature AS name, {r('spearman', 'value')}, CAST(row_number() OVER (ORDER BY spearman DESC, feature) AS INT) AS place FROM ms",
    "heat_map": f"WITH {X.EVENTS_SQL}, {JOINT}, jj AS (SELECT a, b, {JACCARD} AS v FROM w UNION ALL SELECT b, a, {JACCARD} FROM w) SELECT p.source AS a, q.source AS b, round(CASE WHEN p.source = q.source THEN 1.0 ELSE coalesce(v, 0) END, 6)::DOUBLE AS value FROM srcs p CROSS JOIN srcs q LEFT JOIN jj ON jj.a = p.source AND jj.b = q.source",
    "missing_flag_names": ORACLES["missingness_auc"].replace("SELECT feature, round", "SELECT replace(feature, '__isna', '') AS feature, round"),
    "holdout_split": f"WITH {X.DOC_SQL}, {PLACED} SELECT row_id, y, CASE WHEN (place - 1)::DOUBLE / n < 0.25 THEN 'test' ELSE 'train' END AS split FROM pl",
    "metric_summary": f"WITH {X.DOC_SQL}, lng AS (SELECT 'all' AS feature, row_id, y, least(n_chars / 20000, 1.0) AS x FROM doc), {CUM}, {BRIER}, mt2 AS (SELECT {AUC} AS auc, sum(dp::DOUBLE / dn * pos / n1) AS ap, greatest(0, max(dp::DOUBLE / n1 - (dn - dp)::DOUBLE / (nt - n1))) AS ks FROM u) SELECT 'all' AS part, {r('auc', 'auc')}, {r('2 * auc - 1', 'gini')}, {r('ap', 'ap')}, {r('ks', 'ks')}, {r('brier', 'brier')}, {r('logloss', 'logloss')} FROM mt2, br",
    "strict_label": f"WITH {X.SNAP_SQL}, m AS (SELECT 'default_hi' AS variable, avg(CASE WHEN ret_share > 0.5 THEN 1 WHEN ret_share <= 0.5 THEN 0 END) AS p FROM snap UNION ALL SELECT 'overdue_hi', avg(CASE WHEN avg_disc > 0.053 THEN 1 WHEN avg_disc <= 0.053 THEN 0 END) FROM snap) SELECT variable, {r('p', 'positive_rate')} FROM m WHERE p BETWEEN 0.005 AND 0.4 ORDER BY p, variable LIMIT 1",
    "set_stability": f"WITH {X.SNAPLONG_SQL}, c AS (SELECT row_id % 3 AS run, list(DISTINCT feature) AS l FROM (SELECT row_id % 3 AS row_id, feature FROM lng GROUP BY 1, 2 HAVING sum(x) > 12000) GROUP BY 1) SELECT 'L1' AS method, round(avg(len(list_intersect(p.l, q.l))::DOUBLE / len(list_distinct(list_concat(p.l, q.l)))), 6) AS jaccard FROM c p JOIN c q ON p.run < q.run HAVING count(*) > 0",
    "dtype_split": f"WITH {X.SNAP_SQL}, c AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM (WITH {X.SNAP_SQL} SELECT * FROM snap))) SELECT column_name AS \"column\", column_type <> 'VARCHAR' AS is_numeric FROM c",
    "truncated_names": "SELECT p_partkey, p_name[:12] AS p_name FROM part",
    "encoded_categories": f"WITH {X.SNAP_SQL} SELECT row_id, " + ", ".join(f"CASE WHEN segment = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS segment__is_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + f", {r('count(*) OVER (PARTITION BY nation) * 1.0::DOUBLE / count(*) OVER ()', 'nation__freq')} FROM snap",
    "warmup_schedule": "WITH n AS (SELECT count(*) AS n, floor(count(*) * 0.06) AS w FROM events) SELECT event_id AS step, round(1000 * CASE WHEN event_id < w THEN 1e-3 * event_id / w ELSE 1e-6 + 0.5 * (1e-3 - 1e-6) * (1 + cos(pi() * (event_id - w) / (n - w)::DOUBLE)) END, 6)::DOUBLE AS rate FROM events, n",
}
_FEATURES = [f for f in X.SNAP_FEATURES if f != "ret_share"]


def psi(n: str) -> str:
    """digamma(n) by its series at n + 10."""
    y = f"({n} + 10.0::DOUBLE)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) - (" + " + ".join(f"1 / ({n} + {i}.0::DOUBLE)" for i in range(10)) + "))"


ORACLES["mi_knn"] = f"""WITH {X.SNAPLONG_SQL}, en AS (SELECT feature, min(x) AS low, max(x) - min(x) AS span FROM lng WHERE x IS NOT NULL GROUP BY 1),
 v AS (SELECT lng.feature, row_id, y, CAST(floor((x - low) * CASE WHEN span > 0 THEN pow(2.0::DOUBLE, 40 - floor(log2(span))) ELSE 0.0 END + 0.5) AS BIGINT) AS v FROM lng JOIN en USING (feature) WHERE x IS NOT NULL),
 nc AS (SELECT feature, y, count(*) AS nc, least(count(*) - 1, 3) AS k FROM v GROUP BY 1, 2 HAVING count(*) > 1),
 pt AS (SELECT v.*, nc, k FROM v JOIN nc USING (feature, y)),
 ds AS (SELECT a.feature, a.row_id, a.v, a.nc, a.k, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.feature, a.row_id ORDER BY abs(a.v - b.v)) AS i FROM pt a JOIN pt b ON a.feature = b.feature AND a.y = b.y AND a.row_id <> b.row_id),
 rd AS (SELECT feature, row_id, v, nc, k, greatest(d - 1, 0) AS reach FROM ds WHERE i = k),
 mm AS (SELECT rd.feature, rd.row_id, rd.nc, rd.k, count(*) AS m FROM rd JOIN pt ON rd.feature = pt.feature AND abs(pt.v - rd.v) <= rd.reach GROUP BY 1, 2, 3, 4)
 SELECT feature, round(greatest(0, {psi('count(*)')} + avg({psi('k')} - {psi('nc')} - {psi('m')})), 6) AS mi FROM mm GROUP BY 1"""

_BIN_QS = ", ".join(f"{i / 31!r}" for i in range(1, 31))
ORACLES["split_gains"] = f"""WITH {X.SNAP_SQL}, lng AS ({X._union('snap', _FEATURES, 'row_id, y')}), bs AS (SELECT avg(y::DOUBLE) AS p0 FROM snap), pr AS (SELECT 1 / (1 + exp(-ln(p0 / (1 - p0)))) AS p FROM bs),
 ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [{_BIN_QS}]))) AS es FROM lng WHERE x IS NOT NULL GROUP BY 1),
 bn AS (SELECT lng.feature, CASE WHEN x IS NULL THEN 0 ELSE 1 + len(list_filter(es, lambda e: e < x)) END AS bin, es, CAST(round((p - y) * 268435456) AS BIGINT) AS g, CAST(round(p * (1 - p) * 268435456) AS BIGINT) AS h FROM lng JOIN ed USING (feature), pr),
 cl AS (SELECT feature, bin, es, sum(g) AS g, sum(h) AS h, count(*) AS n FROM bn GROUP BY 1, 2, 3),
 al AS (SELECT feature, sum(g) AS tg, sum(h) AS th, sum(n) AS tn, sum(CASE WHEN bin = 0 THEN g ELSE 0 END) AS mg, sum(CASE WHEN bin = 0 THEN h ELSE 0 END) AS mh, sum(CASE WHEN bin = 0 THEN n ELSE 0 END) AS mn FROM cl GROUP BY 1),
 cu AS (SELECT feature, bin AS b, es, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(n) OVER w AS n FROM cl WHERE bin > 0 WINDOW w AS (PARTITION BY feature ORDER BY bin)),
 sd AS (SELECT feature, b, es, false AS missing_left, g, h, n FROM cu UNION ALL SELECT cu.feature, b, es, true, g + mg, h + mh, n + mn FROM cu JOIN al USING (feature) WHERE mn > 0),
 gh AS (SELECT sd.feature, b, es, missing_left, n, tn, g / 268435456.0::DOUBLE AS gl, h / 268435456.0::DOUBLE AS hl, (tg - g) / 268435456.0::DOUBLE AS gr, (th - h) / 268435456.0::DOUBLE AS hr, tg / 268435456.0::DOUBLE AS gt, th / 268435456.0::DOUBLE AS ht FROM sd JOIN al USING (feature)),
 gn AS (SELECT *, 0.5 * gl * gl / (hl + 1) + 0.5 * gr * gr / (hr + 1) - 0.5 * gt * gt / (ht + 1) AS gain FROM gh WHERE n > 0 AND n < tn AND hl >= 1 AND hr >= 1),
 rk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, missing_left, b) AS i FROM gn WHERE gain > 1e-9)
 SELECT feature, CAST(b AS INT) AS \"at\", missing_left, round(es[b], 6) AS edge, round(gain, 6) AS gain FROM rk WHERE i = 1"""

_WEIGHTS = {"acctbal": -1, "n_orders": 300, "avg_price": 2, "n_lines": 100, "avg_qty": 50, "n_events": -10}
_CELLS = [f"floor(coalesce({f}, 0)) * {w}" for f, w in _WEIGHTS.items()]
_VARIANTS = " UNION ALL ".join(
    f"SELECT {j} AS f, {k} AS rep, a.y, " + " + ".join(f"floor(coalesce({'b' if i == j else 'a'}.{c}, 0)) * {w}" for i, (c, w) in enumerate(_WEIGHTS.items())) + f" AS x FROM pl a JOIN pl b ON b.place = (a.place - 1 + 1 + {(2 * j + k) * 7919 + 42} % (a.n - 1)) % a.n + 1"
    for j in range(len(_WEIGHTS))
    for k in range(2)
)
ORACLES["permuted_auc"] = f"""WITH {X.SNAP_SQL}, pl AS (SELECT *, row_number() OVER (ORDER BY md5(row_id || '|42'), row_id) AS place, count(*) OVER () AS n FROM snap),
 vr AS (SELECT -1 AS f, 0 AS rep, y, {' + '.join(_CELLS)} AS x FROM pl UNION ALL {_VARIANTS}), lng AS (SELECT f * 2 + rep AS feature, y, x FROM vr), {CUM}, au AS (SELECT feature, {AUC} AS auc FROM u GROUP BY 1)
 SELECT [{', '.join(f"'{f}'" for f in _WEIGHTS)}][CAST(floor(a.feature / 2) AS INT) + 1] AS feature, CAST(a.feature % 2 AS INT) AS repeat, round(a.auc, 6) AS auc, round(b.auc, 6) AS base_auc FROM au a, au b WHERE a.feature >= 0 AND b.feature = -2"""


_rank = lambda c: f"rank() OVER (ORDER BY coalesce({c}, 0) DESC) + (count(*) OVER (PARTITION BY coalesce({c}, 0)) - 1) / 2.0::DOUBLE"
_SCORE_NAMES = ("mi", "iv", "missing_auc")
ORACLES["consensus_table"] = f"""WITH a AS ({ORACLES['mi_kbins']}), b AS ({ORACLES['iv_qcut'].replace(X.DOCLONG_SQL, X.SNAPLONG_SQL)}), c AS ({ORACLES['missing_flag_names']}), k AS ({ORACLES['corr_prune']}),
 j AS (SELECT coalesce(a.feature, b.feature, c.feature) AS variable, mi, iv, auc AS missing_auc FROM a FULL JOIN b ON a.feature = b.feature FULL JOIN c ON coalesce(a.feature, b.feature) = c.feature),
 q AS (SELECT *, {', '.join(f'{_rank(c)} AS rank_{c}' for c in _SCORE_NAMES)} FROM j)
 SELECT variable, mi, iv, missing_auc, {', '.join(f'rank_{c}' for c in _SCORE_NAMES)}, round(({' + '.join(f'rank_{c}' for c in _SCORE_NAMES)}) / 3, 6) AS consensus_rank, CAST(coalesce(kept, false) AS INT) AS kept_after_prune FROM q LEFT JOIN k ON k.feature = q.variable"""

_KIND_WORDS = {"n_orders": "orders made", "acctbal": "account balance", "ret_share": "returned part"}
_kind = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
ORACLES["numeric_kinds"] = f"""WITH {X.SNAPLONG_SQL}, sh AS (SELECT feature, avg(CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS non_negative, avg(CASE WHEN x = floor(x) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS integral, avg(CASE WHEN x BETWEEN -5 AND 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS small FROM lng WHERE x IS NOT NULL GROUP BY 1),
 tt AS (SELECT *, CASE feature {' '.join(f"WHEN '{f}' THEN '{t}'" for f, t in _KIND_WORDS.items())} ELSE feature END AS t FROM sh)
 SELECT feature, {r('non_negative', 'non_negative')}, {r('integral', 'integral')}, {r('small', 'small')}, CASE {' '.join(f"WHEN {_kind(w)} THEN '{k}'" for k, w in P.NUMERIC_KINDS.items())} WHEN non_negative > 0.98 AND integral > 0.95 THEN 'count' WHEN small > 0.98 THEN 'ratio' ELSE 'other' END AS kind FROM tt"""


def _cluster_rounds(rounds: int) -> str:
    """Common table expressions of k-means with two centres over mat (s, dim, v), beginning with c0 (c, dim, v)."""
    out = []
    for i in range(rounds + 1):
        out.append(f"d{i} AS (SELECT m.s, c.c, round(sum(pow(m.v - c.v, 2)), 9) AS d FROM mat m JOIN c{i} c USING (dim) GROUP BY 1, 2), a{i} AS (SELECT s, c FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, c) AS k FROM d{i}) WHERE k = 1)")
        if i < rounds:
            out.append(f"c{i + 1} AS (SELECT c.c, c.dim, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT a.c, m.dim, avg(m.v) AS v FROM a{i} a JOIN mat m USING (s) GROUP BY 1, 2) n ON n.c = c.c AND n.dim = c.dim)")
    return ", ".join(out)


ORACLES["label_clustered"] = f"""WITH {X.EVENTS_SQL}, cr AS (SELECT a.source AS s, b.source AS dim, corr(a.event::DOUBLE, b.event::DOUBLE) AS r FROM ev a JOIN ev b ON a.row_id = b.row_id AND a.source <> b.source GROUP BY 1, 2),
 mat AS (SELECT s, dim, round(abs(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END), 9) AS v FROM cr UNION ALL SELECT source, source, 1.0 FROM srcs), f AS (SELECT source AS s FROM srcs ORDER BY weight DESC, source LIMIT 1),
 g AS (SELECT m.s FROM mat m JOIN (SELECT dim, v FROM mat JOIN f USING (s)) c USING (dim) GROUP BY m.s ORDER BY round(sum(pow(m.v - c.v, 2)), 9) DESC, m.s LIMIT 1),
 c0 AS (SELECT 0 AS c, dim, v FROM mat JOIN f USING (s) UNION ALL SELECT 1, dim, v FROM mat JOIN g USING (s)), {_cluster_rounds(10)},
 rp AS (SELECT s FROM (SELECT a.s, row_number() OVER (PARTITION BY a.c ORDER BY weight DESC, a.s) AS k FROM a10 a JOIN srcs ON srcs.source = a.s) WHERE k = 1)
 SELECT row_id, max(CASE WHEN source IN (SELECT s FROM rp) THEN event ELSE 0 END) AS label_clustered FROM ev GROUP BY 1"""

_PART_METRICS = "auc gini ap ks brier logloss".split()
ORACLES["fold_metrics"] = f"""WITH {X.DOC_SQL}, {PLACED}, sc AS (SELECT y, (place - 1) % 5 AS fold, least(n_chars / 20000, 1.0) AS x FROM pl), lng AS (SELECT 'fold' || CAST(fold AS VARCHAR) AS feature, y, x FROM sc UNION ALL SELECT 'oof', y, x FROM sc), {CUM},
 bl AS (SELECT feature, avg(pow(x - y, 2)) AS brier, avg(-(y * ln(least(greatest(x, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(x, 1e-15), 1 - 1e-15)))) AS logloss FROM lng GROUP BY 1),
 mt AS (SELECT feature, {AUC} AS auc, sum(CASE WHEN n1 > 0 THEN dp::DOUBLE / dn * pos / n1 ELSE 0 END) AS ap, greatest(0, max(dp::DOUBLE / n1 - (dn - dp)::DOUBLE / (nt - n1))) AS ks FROM u GROUP BY 1),
 al AS (SELECT feature AS part, auc, 2 * auc - 1 AS gini, ap, ks, brier, logloss FROM mt JOIN bl USING (feature)), fd AS (SELECT * FROM al WHERE part <> 'oof'),
 un AS (SELECT * FROM al UNION ALL SELECT 'mean', {', '.join(f'avg({c})' for c in _PART_METRICS)} FROM fd UNION ALL SELECT 'sd', {', '.join(f'stddev_samp({c})' for c in _PART_METRICS)} FROM fd)
 SELECT part, {', '.join(r(c, c) for c in _PART_METRICS)} FROM un"""
for _name in [n for n, s in ORACLES.items() if not s]:
    del ORACLES[_name]
