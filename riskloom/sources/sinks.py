"""Writers: tables, lists, JSON, reports, metrics and models."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A short list as one text file."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def plain(x):
    """NumPy values and sets as JSON has them."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted(map(plain, x))
    if isinstance(x, np.ndarray):
        return plain(x.tolist())
    return x.item() if isinstance(x, np.generic) else str(x) if isinstance(x, Path) else x


def write_json(obj, path: str) -> None:
    Path(path).write_text(json.dumps(plain(obj), indent=2, sort_keys=True), encoding="utf-8")


def markdown(title: str, sections: dict[str, list[dict]]) -> str:
    """A report: a table of rows under each heading."""
    out = [f"# {title}"]
    for head, rows in sections.items():
        out.append(f"\n## {head}\n")
        if rows:
            cols = list(rows[0])
            out += ["| " + " | ".join(cols) + " |", "|" + "-|" * len(cols), *("| " + " | ".join(str(r.get(c, "")) for c in cols) + " |" for r in rows)]
    return "\n".join(out) + "\n"


def log_metrics(df: DataFrame, run: str, path: str) -> None:
    """Appends metrics (metric, value) of a run to a table."""
    df.select(F.lit(run).alias("run"), "metric", F.col("value").cast("double").alias("value"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
