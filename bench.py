"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from riskloom.queries import QUERIES

HEADLINE = ["decile_table", "auc_gini_ks", "average_precision", "column_profile", "pearson_pairs", "binary_pairs", "iv_digitize", "mi_binned", "woe_table", "label_weighted", "risk_score", "impute_scale", "stratified_kfold", "target_encode_cv", "leakage_audit", "fold_report", "boosted_report", "model_search"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, failed = {}, {}
    for name in HEADLINE:
        began = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        except Exception as e:  # the others are timed all the same, and the line says which failed
            failed[name] = f"{type(e).__name__}: {e}"[:200]
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "failed": failed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
