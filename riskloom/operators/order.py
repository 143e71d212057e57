"""Order statistics that don't send a whole column to one task.

Values are counted first; running totals are then taken in two levels: within buckets of neighbouring values, and over the
few totals of the buckets. The buckets' edges come from a mergeable sketch, taken once, and only balance the work: any edges
give the same sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

#: Buckets of values at least; beyond it, so many for each shuffle partition of the session.
BUCKETS, BUCKETS_A_PARTITION = 64, 2


def with_each(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of per_key, which has a row for each key and is broadcast. A null key is one too."""
    if not keys:
        return df.crossJoin(F.broadcast(per_key))
    other = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    return df.join(F.broadcast(other), same).drop(*(f"_key_{k}" for k in keys))


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], descending: bool = False, buckets: int | None = None) -> DataFrame:
    """df with running totals {new column: column} in the order of the columns order, within keys. The first order column is numeric.

    Where the second one is numeric too, the rows of a value that fills buckets of its own are dealt by it.
    """
    n = buckets or max(BUCKETS, BUCKETS_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(order[0]).cast("double")
    df = df.persist()  # read three times below; mostly counts of different values
    shares = [i / n for i in range(1, n)]
    ties = len(order) > 1 and dict(df.dtypes)[order[1]] in ("int", "bigint", "double")
    then = F.col(order[1]).cast("double") if ties else None
    edges = df.groupBy(*keys).agg(F.percentile_approx(x, shares, 1000 + 10 * n).alias("_edges"), *([F.percentile_approx(then, shares, 1000 + 10 * n).alias("_then")] if ties else []))
    edges = written(edges, "edges")  # a sketch depends on the order in which its parts come, and rows and totals must see the same buckets
    bucket = F.size(F.filter("_edges", lambda e: e < x)).cast("bigint")
    if ties:  # a value on several edges is the last of its bucket, and has as many buckets of its own
        edged = F.size(F.filter("_edges", lambda e: e == x))
        bucket = bucket * (n + 1) + F.when(edged > 1, 1 + F.floor(F.size(F.filter("_then", lambda e: e < then)) * edged / n)).otherwise(0)
    dealt = with_each(df, edges, keys).withColumn("_bucket", F.when(x.isNull(), -1).otherwise(bucket)).drop("_edges", "_then")
    ordering = [F.desc(c) if descending else F.asc(c) for c in order]
    within = Window.partitionBy(*keys, "_bucket").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy(*keys, "_bucket").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if descending else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))  # a row for each bucket of a key
    out = with_each(dealt, totals, [*keys, "_bucket"])
    new = {n: F.sum(c).over(within) + F.col(f"_b_{n}") for n, c in sums.items()}
    return out.withColumns(new).drop("_bucket", *(f"_b_{n}" for n in sums))


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float]) -> DataFrame:
    """keys and q0, q1, ...: quantiles of the non-null x with linear interpolation between neighbours."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    running = prefix_sums(counts, keys, [x], {"_cum": "_n"})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    running = running.join(F.broadcast(total), keys) if keys else running.crossJoin(F.broadcast(total))
    at = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    wanted = F.array(*(F.struct(F.lit(2 * i + side).alias("slot"), (F.ceil(at(q)) if side else F.floor(at(q))).cast("bigint").alias("place")) for i, q in enumerate(qs) for side in (0, 1)))
    # A value holds the places from _cum - _n to _cum - 1: only values at wanted places go on.
    hits = F.filter(wanted, lambda w: (w["place"] < F.col("_cum")) & (w["place"] >= F.col("_cum") - F.col("_n")))
    found = running.select(*keys, F.col(x).cast("double").alias("_x"), "_total", F.explode(hits).alias("_w")).groupBy(*keys).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_w.slot", "_x"))).alias("_at"))
    low, high = (lambda i: F.element_at("_at", F.lit(2 * i))), (lambda i: F.element_at("_at", F.lit(2 * i + 1)))
    return found.select(*keys, *((low(i) + (high(i) - low(i)) * (at(q) - F.floor(at(q)))).alias(f"q{i}") for i, q in enumerate(qs)))


def average_ranks(df: DataFrame, keys: list[str], x: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """df with the average rank of x within keys (ties share it); null x have none."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    ranks = prefix_sums(counts, keys, [x], {"_cum": "_n"}, descending).select(*keys, x, (F.col("_cum") - F.col("_n") / 2 + 0.5).alias(name))
    return df.join(ranks, [*keys, x], "left")


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, and empty where b is 0."""
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a.cast("double") / F.when(b == 0, None).otherwise(b))
