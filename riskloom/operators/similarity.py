"""Pairwise statistics of columns on the long layout, as edge lists (a < b).

Rows are gathered once; each task multiplies blocks of them and adds up, for every two columns, the sums over the rows that have
both values. Only these sums, a row for each column and task, are shuffled: the work grows with rows times columns for the
gathering and is a matrix product beyond that, and no row meets another row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import average_ranks, ratio

#: Cells of the dense block that a task multiplies at once.
BLOCK_CELLS = 1 << 21
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def column_names(long: DataFrame) -> list[str]:
    return sorted(r["feature"] for r in long.where("x is not null").select("feature").distinct().collect())


def pair_sums(long: DataFrame, other: DataFrame | None = None, names: list[list[str]] | None = None) -> DataFrame:
    """a, b, n, sa, sb, saa, sbb, sab: over the rows with both values, their number and the sums of xa, xb, xa^2, xb^2 and xa xb.

    Columns are a < b of long, or a of long and b of other. A row has one value of a column at most; null values are missing.
    names: the columns of each, if they are known already.
    """
    spark = long.sparkSession
    sides = [long] if other is None else [long, other]
    both = None
    for i, t in enumerate(sides):
        t = t.where("x is not null").select("row_id", F.lit(i).alias("side"), "feature", F.col("x").cast("double").alias("x"))
        both = t if both is None else both.unionByName(t)
    names = names or [column_names(t) for t in sides]
    left, right = names[0], names[-1]
    if not left or not right:
        return spark.createDataFrame([], "a string, b string, n bigint, sa double, sb double, saa double, sbb double, sab double")
    index = spark.createDataFrame([(i, f, k) for i, ns in enumerate(names) for k, f in enumerate(ns)], "side int, feature string, at int")
    rows = both.join(F.broadcast(index), ["side", "feature"]).groupBy("row_id").agg(F.collect_list(F.struct("side", "at", "x")).alias("cells"))
    p, q, same = len(left), len(right), other is None
    schema = pa.schema([("at", pa.int32()), *((c, pa.list_(pa.float64())) for c in _SUMS)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((p, q)) for _ in _SUMS]
        step = max(1, BLOCK_CELLS // (p + q))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                cells = batch.column("cells").slice(lo, step)
                row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                side, at, x = (flat.field(c).to_numpy() for c in ("side", "at", "x"))
                blocks = []
                for i, width in ((0, p), (0 if same else 1, q)):
                    mine = side == i
                    value, there = np.zeros((len(cells), width)), np.zeros((len(cells), width))
                    value[row[mine], at[mine]], there[row[mine], at[mine]] = x[mine], 1.0
                    blocks.append((value, there))
                (u, mu), (v, mv) = blocks
                for t, product in zip(total, (mu.T @ mv, u.T @ mv, mu.T @ v, (u * u).T @ mv, mu.T @ (v * v), u.T @ v)):
                    t += product
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)], schema=schema)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        at = int(rows["at"].iloc[0])
        table = pd.DataFrame({c: np.sum(np.stack(rows[c].to_numpy()), axis=0) for c in _SUMS})
        table.insert(0, "b", right)
        table.insert(0, "a", left[at])
        table["n"] = table["n"].astype("int64")
        return table[(table["n"] > 0) & (table["a"] < table["b"] if same else True)]

    parts = rows.select("cells").mapInArrow(sums, "at int, " + ", ".join(f"{c} array<double>" for c in _SUMS))
    return parts.groupBy("at").applyInPandas(add, "a string, b string, n bigint, sa double, sb double, saa double, sbb double, sab double")


def phi_of(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    c = [x.cast("double") for x in (n11, n10, n01, n00)]
    den = (c[0] + c[1]) * (c[2] + c[3]) * (c[0] + c[2]) * (c[1] + c[3])
    return F.when(den == 0, 0.0).otherwise((c[0] * c[3] - c[1] * c[2]) / F.sqrt(F.when(den != 0, den)))


def binary_pairs(long: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """a, b, jaccard (0 for an empty union), phi (0 if degenerate) and mutual_info (nats) of columns taken as x > 0."""
    names = [column_names(t) for t in (long, other) if t is not None]
    flag = lambda t: None if t is None else t.where("x is not null").select("row_id", "feature", (F.col("x") > 0).cast("double").alias("x"))
    t = pair_sums(flag(long), flag(other), names)
    both = F.round("sab").cast("bigint")
    n = t.select("a", "b", "n", both.alias("n11"), (F.round("sa").cast("bigint") - both).alias("n10"), (F.round("sb").cast("bigint") - both).alias("n01"))
    n = n.withColumn("n00", F.col("n") - F.col("n11") - F.col("n10") - F.col("n01"))
    c = {(i, j): F.col(f"n{i}{j}") for i in (0, 1) for j in (0, 1)}
    mi = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            row, col = c[i, 0] + c[i, 1], c[0, j] + c[1, j]
            mi = mi + F.when(c[i, j] > 0, c[i, j] / F.col("n") * F.log(c[i, j].cast("double") * F.col("n") / F.when(c[i, j] > 0, row.cast("double") * col))).otherwise(0.0)
    union = c[1, 1] + c[1, 0] + c[0, 1]
    return n.select("a", "b", ratio(c[1, 1], union, 0.0).alias("jaccard"), phi_of(c[1, 1], c[1, 0], c[0, 1], c[0, 0]).alias("phi"), mi.alias("mutual_info"))


def mutual_info(df: DataFrame, keys: list[str], u: str, v: str, inner: float = 0.0) -> DataFrame:
    """keys, mi (nats) of two discrete columns; inner is added to the product of the margins, and to the quotient, in dialects that do so."""
    joint = df.groupBy(*keys, u, v).agg(F.count("*").alias("n")).persist()
    pu = joint.groupBy(*keys, u).agg(F.sum("n").alias("nu"))
    pv = joint.groupBy(*keys, v).agg(F.sum("n").alias("nv"))
    total = joint.groupBy(*keys).agg(F.sum("n").alias("nt"))
    t = joint.join(pu, [*keys, u]).join(F.broadcast(pv), [*keys, v])
    t = t.join(F.broadcast(total), keys) if keys else t.crossJoin(F.broadcast(total))
    nt = F.col("nt").cast("double")
    p = F.col("n") / nt
    return t.groupBy(*keys).agg(F.sum(p * F.log(p / (F.col("nu") / nt * (F.col("nv") / nt) + inner) + inner)).alias("mi"))


def standardised(long: DataFrame) -> DataFrame:
    """long (row_id, feature, x) with x less its feature's mean, over its deviation: sums of squares then lose no digits. Constants become 0."""
    m = long.groupBy("feature").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return long.join(F.broadcast(m), "feature").select("row_id", "feature", F.when(F.col("_s") > 0, (F.col("x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))).otherwise(F.when(F.col("x").isNotNull(), 0.0)).alias("x"))


def pearson(long: DataFrame, other: DataFrame | None = None, names: list[list[str]] | None = None) -> DataFrame:
    """a, b, n, r over the rows that have both; null if either is constant there."""
    t = pair_sums(standardised(long), None if other is None else standardised(other), names or [column_names(t) for t in (long, other) if t is not None])
    n = F.col("n").cast("double")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    # A constant's variance is 0 but for rounding.
    ok = (va > 1e-12 * n * F.col("saa")) & (vb > 1e-12 * n * F.col("sbb"))
    return t.select("a", "b", "n", F.when(ok, (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(F.when(ok, va)) / F.sqrt(F.when(ok, vb))).alias("r"))


def spearman(long: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """a, b, n, r of average ranks."""
    # Ranks are kept: their moments and their sums read them.
    rank = lambda t: average_ranks(t.where("x is not null"), ["feature"], "x").select("row_id", "feature", F.col("rank").alias("x")).persist()
    return pearson(rank(long), None if other is None else rank(other), [column_names(t) for t in (long, other) if t is not None])


def anova_f(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f of x between the classes y; null if a class is missing or nothing varies within."""
    g = df.where("x is not null and y is not null").groupBy(*keys, "y").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    s = g.groupBy(*keys).agg(F.sum("n").alias("nt"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("nt")
    ok = (F.col("k") > 1) & (F.col("within") > 0) & (F.col("nt") > F.col("k"))
    return s.select(*keys, F.when(ok, between / (F.col("k") - 1) / (F.when(ok, F.col("within")) / (F.col("nt") - F.col("k")))).alias("f"))
