"""Stand-ins for the method's inputs, built from the star-schema tables by queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .operators.order import exact_quantiles
from .operators.profile import to_long

DOC_FEATURES = ["n_chars", "n_words", "n_digits"]
SNAP_FEATURES = ["acctbal", "n_orders", "avg_price", "urgent_share", "n_lines", "avg_disc", "avg_qty", "ret_share", "n_events", "event_value"]
#: Sources of labels: weight and window.
SOURCES = [("avg_disc_hi", 0.60, "6m"), ("neg_balance", 0.95, "3m"), ("returns_hi", 0.75, "12m"), ("urgent_hi", 0.50, "unknown")]
META = [
    ("user_id", ""), ("panel", ""), ("idle", ""), ("leader_count", "number of leaders"), ("c_acctbal", "account balance"), ("account_age", "age of account"), ("mobile_no", ""),
    ("paid", ""), ("companion", ""), ("grid", ""), ("l_returnflag", "return flag"), ("c_custkey", "customer key"), ("mission", ""), ("inpatient", ""), ("spinach", ""),
    ("specs", ""), ("transmission", ""), ("unpaid", ""), ("spend_a", "spend last 3 month"), ("flag_b", "flag [last 3 months]"), ("spend_c", "lifetime spend"), ("late_d", "ever late"),
    ("ever_late", ""), ("x_3m", ""), ("order_month", ""), ("ts", ""), ("days_since_order_month", ""), ("average_day_x", ""), ("order_date", ""), ("l_shipdate", "ship date"),
    ("var101022", "ever 90 dpd in loans"), ("var207028", "over limit amount last 6 month"), ("default_flag", "defaulted loans"), ("refdate_x", "reference"), ("purchase_count", "number of purchases"),
    ("util_ratio", "utilization"), ("fraud_mark", "suspicious blocks"), ("min_due_paid", "min due missed 30 dpd"), ("email_address", "email"), ("bad_debtors", "bad debtors"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y (toxic), lang, source and three features of each labelled document."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    return d.join(y, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("y"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split(text, " ")).cast("double").alias("n_words"),
        F.length(F.regexp_replace(text, "[^0-9]", "")).cast("double").alias("n_digits"),
    )


def doc_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(doc_scored(spark, sf_dir), DOC_FEATURES, ("row_id", "y"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide row for each customer: orders, line items and (for few) events. Facts are summed by customer before any join.

    A mean of 32 hundredths may end in a 5 at the seventh place. Twelve places first take off what the order of the sum adds, so the mean is the same every time.
    """
    c, o, li, e, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "events", "nation"))
    orders = o.groupBy(F.col("o_custkey").alias("row_id")).agg(F.count("*").cast("double").alias("n_orders"), F.round(F.avg("o_totalprice"), 7).alias("avg_price"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share"))
    lines = li.join(o.select("o_orderkey", F.col("o_custkey").alias("row_id")), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("row_id").agg(
        F.count("*").cast("double").alias("n_lines"), F.round(F.round(F.avg("l_discount"), 12), 6).alias("avg_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("ret_share")
    )
    events = e.groupBy(F.col("user_id").alias("row_id")).agg(F.count("*").cast("double").alias("n_events"), F.round(F.sum("value"), 4).alias("event_value"))
    base = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    out = base.join(orders, "row_id", "left").join(lines, "row_id", "left").join(events, "row_id", "left")
    return out.withColumn("y", (F.coalesce("ret_share", F.lit(0.0)) > 0.4).cast("int"))


def snap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(snapshot(spark, sf_dir), SNAP_FEATURES, ("row_id", "y"))


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, source, event, severity of four sources."""
    long = to_long(snapshot(spark, sf_dir), ["acctbal", "avg_disc", "ret_share", "urgent_share"])
    cut = exact_quantiles(long.where("feature <> 'acctbal'"), ["feature"], "x", [0.95])
    names = F.create_map(*(F.lit(v) for v in ("acctbal", "neg_balance", "avg_disc", "avg_disc_hi", "ret_share", "returns_hi", "urgent_share", "urgent_hi")))
    t = long.join(F.broadcast(cut), "feature", "left")
    event = F.when(F.col("feature") == "acctbal", F.col("x") < 0).otherwise(F.col("x") >= F.col("q0"))
    severity = F.when(F.col("feature") == "acctbal", F.log1p(F.greatest(-F.coalesce("x", F.lit(0.0)), F.lit(0.0)))).otherwise(F.log1p(F.coalesce("x", F.lit(0.0))))
    return t.select("row_id", names[F.col("feature")].alias("source"), F.coalesce(event, F.lit(False)).cast("int").alias("event"), F.round(severity, 9).alias("severity"))


def source_meta(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, weight double, window string")


def column_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A described column for each part: the first ones as META has them, the others with the part's number and type."""
    names = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(META)], "i int, n string, t string")
    key, first = F.col("p_partkey"), F.col("p_partkey") < len(META)
    parts = table(spark, sf_dir, "part").join(F.broadcast(names), F.pmod(key, F.lit(len(META))) == F.col("i"))  # META's rows
    return parts.select(F.when(first, F.col("n")).otherwise(F.concat("n", F.lit("."), key.cast("string"))).alias("column_name"), F.when(first, F.col("t")).otherwise(F.concat("t", F.lit(" "), F.lower("p_type"))).alias("description"))


def described(spark: SparkSession, names: list[str], texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(n, texts.get(n, "")) for n in names], "variable string, description string").withColumn("text", P.text("variable", "description"))


# The same tables in DuckDB's SQL, as common table expressions.
DOC_SQL = """doc AS (SELECT d.doc_id AS row_id, l.toxic AS y, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
  CAST(length(regexp_replace(d.text, '[^0-9]', '', 'g')) AS DOUBLE) AS n_digits FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _union(source: str, features: list[str], ids: str) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {source}" for f in features)


DOCLONG_SQL = f"{DOC_SQL}, lng AS ({_union('doc', DOC_FEATURES, 'row_id, y')})"
SNAP_SQL = """ord AS (SELECT o_custkey AS row_id, CAST(count(*) AS DOUBLE) AS n_orders, round(avg(o_totalprice), 7) AS avg_price, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent_share FROM orders GROUP BY 1),
 lin AS (SELECT o.o_custkey AS row_id, CAST(count(*) AS DOUBLE) AS n_lines, round(avg(l_discount), 6) AS avg_disc, round(avg(l_quantity), 6) AS avg_qty, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ret_share
   FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1),
 evt AS (SELECT user_id AS row_id, CAST(count(*) AS DOUBLE) AS n_events, round(sum(value), 4) AS event_value FROM events GROUP BY 1),
 snap AS (SELECT c.c_custkey AS row_id, c.c_acctbal AS acctbal, c.c_mktsegment AS segment, n.n_name AS nation, ord.n_orders, ord.avg_price, ord.urgent_share, lin.n_lines, lin.avg_disc, lin.avg_qty, lin.ret_share, evt.n_events, evt.event_value,
   CASE WHEN coalesce(lin.ret_share, 0) > 0.4 THEN 1 ELSE 0 END AS y
   FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN ord ON ord.row_id = c.c_custkey LEFT JOIN lin ON lin.row_id = c.c_custkey LEFT JOIN evt ON evt.row_id = c.c_custkey)"""
SNAPLONG_SQL = f"{SNAP_SQL}, lng AS ({_union('snap', SNAP_FEATURES, 'row_id, y')})"
EVENTS_SQL = f"""{SNAP_SQL}, cuts AS (SELECT quantile_cont(avg_disc, 0.95) AS d, quantile_cont(ret_share, 0.95) AS r, quantile_cont(urgent_share, 0.95) AS u FROM snap),
 ev AS (SELECT row_id, 'neg_balance' AS source, CASE WHEN acctbal < 0 THEN 1 ELSE 0 END AS event, round(ln(1 + greatest(-coalesce(acctbal, 0), 0)), 9) AS severity FROM snap
  UNION ALL SELECT row_id, 'avg_disc_hi', CASE WHEN avg_disc >= d THEN 1 ELSE 0 END, round(ln(1 + coalesce(avg_disc, 0)), 9) FROM snap, cuts
  UNION ALL SELECT row_id, 'returns_hi', CASE WHEN ret_share >= r THEN 1 ELSE 0 END, round(ln(1 + coalesce(ret_share, 0)), 9) FROM snap, cuts
  UNION ALL SELECT row_id, 'urgent_hi', CASE WHEN urgent_share >= u THEN 1 ELSE 0 END, round(ln(1 + coalesce(urgent_share, 0)), 9) FROM snap, cuts),
 srcs(source, weight, win) AS (VALUES {', '.join(f"('{s}', {w}::DOUBLE, '{t}')" for s, w, t in SOURCES)})"""
META_SQL = (
    "named(i, n, t) AS (VALUES "
    + ", ".join(f"({i}, '{n}', '{d}')" for i, (n, d) in enumerate(META))
    + f"""), meta AS (SELECT CASE WHEN p_partkey < {len(META)} THEN n ELSE n || '.' || CAST(p_partkey AS VARCHAR) END AS column_name, CASE WHEN p_partkey < {len(META)} THEN t ELSE t || ' ' || lower(p_type) END AS description
 FROM part JOIN named ON p_partkey % {len(META)} = i), mt AS (SELECT *, lower(column_name || ' ' || description) AS t FROM meta)"""
)
