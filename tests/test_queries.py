"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.oracles import ORACLES
from riskloom.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    def one(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)):
            return None if math.isnan(v) else round(float(v), 5) + 0.0
        return v

    return sorted((tuple(one(r[columns.index(c)]) for c in order) for r in rows), key=repr)


NEW = "label_candidates label_sources label_sources_table binarised_sources dominance_prune jaccard_dedup leak_report corr_prune corr_prune_strict component_prune redundant_columns consensus_rank combined_score per_label_scores single_feature_scan heat_map spearman_pairs strict_label metric_summary encoded_categories verification_guard mi_knn split_gains permuted_auc fold_metrics label_clustered consensus_table numeric_kinds guard_from_files severe_sources warmup_schedule forbidden_window_columns".split()


@pytest.mark.parametrize("name", NEW + ["decile_table", "auc_gini_ks", "column_profile", "column_roles", "outcome_score", "binary_pairs", "iv_digitize", "woe_categorical", "label_union", "guard_reasons", "stratified_split", "target_encode_cv", "coerce_values", "fill_rate_filter"])
def test_equals_duckdb(spark, duck, name):
    c = duck.execute(ORACLES[name])
    columns = [x[0] for x in c.description]
    want = c.fetchall()
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got, want = plain([tuple(r) for r in df.collect()], df.columns, order), plain(want, columns, order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)


def test_values_keep_their_places(spark, tmp_path):
    """A mean of prices has seven places, as in the SQL; a mean of discounts that ends in a 5 at the seventh rounds up however its lines are dealt."""
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    spark.sql("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer limit 2").withColumn("c_custkey", F.monotonically_increasing_id() % 2 + 1).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.table("orders").limit(32).select(F.row_number().over(Window.orderBy("o_orderkey")).cast("bigint").alias("o_orderkey"), F.lit(1).cast("bigint").alias("o_custkey"), "o_orderstatus", "o_orderdate", "o_orderpriority")
    orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.03).otherwise(0.0)).write.parquet(f"{tmp_path}/orders.parquet")
    one = spark.table("lineitem").limit(1).drop("l_orderkey", "l_discount")
    hundredths = [x for x in [2, 1, 8, 4, 0, 10, 1, 1] for _ in range(4)]
    hundredths[0] += 1
    discounts = [x / 100 for x in hundredths]
    dealt = [(i + 1, x) for i, x in enumerate(discounts)]
    found = set()
    for lines in (sorted(dealt, key=lambda r: r[1]), sorted(dealt, key=lambda r: -r[1]), dealt):
        spark.createDataFrame(lines, "l_orderkey bigint, l_discount double").coalesce(1).crossJoin(one).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        for t in ("nation", "events"):
            spark.table(t).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        x = {r.feature: r.x for r in QUERIES["value_counts_dominant"](spark, str(tmp_path)).where("feature in ('avg_disc', 'avg_price')").collect()}
        found.add((x["avg_disc"], x["avg_price"]))
    assert found == {(0.034063, 0.0009375)}


def test_plan_of_label_scores_is_small(spark):
    """The plans of all methods in one filled the driver's memory."""
    assert len(QUERIES["per_label_scores"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) < 20000
