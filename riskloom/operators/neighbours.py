"""Mutual information of numeric features and classes by distances to the k-th neighbour of the same class.

A feature's values are measured in whole steps, some 2**-BITS of its range, so distances are exact. Equal values are counted first. The values are then dealt to ranges;
within a range a window finds the neighbours of each, and the first and last k values of the ranges, put in order again, give those that lie beyond a range's
ends. How many points of any class lie nearer than the k-th neighbour is the difference of two running totals, taken for all points at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .order import BUCKETS, BUCKETS_A_PARTITION, prefix_sums

BITS = 40
#: Edges of ranges that are broadcast at most, over all features.
MOST_EDGES = 1 << 20
_STEPS = 10


def digamma(n: Column) -> Column:
    """The digamma function of numbers of 1 and more, to ten digits."""
    x = n.cast("double")
    y = x + _STEPS
    back = sum((1 / (x + i) for i in range(1, _STEPS)), 1 / x)
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0))) - back


def in_steps(long: DataFrame, bits: int = BITS) -> DataFrame:
    """feature, y, v, n: the finite values x of long as whole numbers of steps from the feature's least one, and how many there are of each. A feature of one value has v = 0."""
    t = long.where("x is not null and y is not null and not isnan(x) and abs(x) < double('infinity')").select("feature", "y", F.col("x").cast("double").alias("x"))
    ends = t.groupBy("feature").agg(F.min("x").alias("low"), (F.max("x") - F.min("x")).alias("span"))  # a row a feature
    step = F.when(F.col("span") > 0, F.pow(F.lit(2.0), F.lit(bits) - F.floor(F.log2("span")))).otherwise(0.0)
    return t.join(F.broadcast(ends), "feature").groupBy("feature", "y", F.floor((F.col("x") - F.col("low")) * step + 0.5).cast("bigint").alias("v")).agg(F.count("*").alias("n"))


def kth_distances(values: DataFrame, k: int, buckets: int | None = None) -> DataFrame:
    """values (feature, y, v, n, all of them different) with r: the distance from v to the k-th other point of its class (to the last one, if there are fewer); classes of one point are left out."""
    spark = values.sparkSession
    classes = values.groupBy("feature", "y").agg(F.sum("n").alias("nc")).where("nc > 1").withColumn("k", F.least(F.col("nc") - 1, F.lit(k)))
    features = max(1, classes.select("feature").distinct().count())
    n = buckets or min(max(BUCKETS, BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))), max(2, MOST_EDGES // features))
    edges = values.groupBy("feature").agg(F.percentile_approx("v", [i / n for i in range(1, n)], 1000 + 10 * n).alias("edges"))
    range_ = F.size(F.filter("edges", lambda e: e < F.col("v")))
    dealt = values.join(F.broadcast(classes.drop("nc")), ["feature", "y"]).join(F.broadcast(edges), "feature").withColumn("range", range_).drop("edges")
    own, point = Window.partitionBy("feature", "y", "range").orderBy("v"), F.struct("v", "n")
    dealt = dealt.withColumns({"left": F.collect_list(point).over(own.rowsBetween(-k, -1)), "right": F.collect_list(point).over(own.rowsBetween(1, k))})
    dealt = written(dealt, "neighbours")
    border = (F.size("left") < k) | (F.size("right") < k)
    over = Window.partitionBy("feature", "y").orderBy("v")  # 2 k values of each range
    ends = dealt.where(border).withColumns({"left_": F.collect_list(point).over(over.rowsBetween(-k, -1)), "right_": F.collect_list(point).over(over.rowsBetween(1, k))})
    ends = ends.withColumns({"left": F.when(F.size("left") < k, F.col("left_")).otherwise(F.col("left")), "right": F.when(F.size("right") < k, F.col("right_")).otherwise(F.col("right"))}).drop("left_", "right_")
    both = dealt.where(~border).unionByName(ends)
    away = lambda side, sign: F.transform(side, lambda o: F.struct((sign * (o["v"] - F.col("v"))).alias("d"), o["n"].alias("n")))
    near = F.array_sort(F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("d"), (F.col("n") - 1).alias("n"))), away("left", -1), away("right", 1)))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("d"))
    r = F.aggregate(near, zero, lambda a, o: F.when(a["n"] >= F.col("k"), a).otherwise(F.struct((a["n"] + o["n"]).alias("n"), o["d"].alias("d"))), lambda a: a["d"])
    return both.select("feature", "y", "v", "n", "k", r.alias("r"))


def mi_knn(long: DataFrame, k: int = 3, bits: int = BITS, buckets: int | None = None) -> DataFrame:
    """feature, mi of long (feature, x, y): psi(N) + <psi(k)> - <psi(points of the class)> - <psi(points nearer than the k-th of the class)>, not below 0.

    Averages are over the N points of classes of two points or more; where the k-th neighbour is at distance 0, equal values count. Null, NaN and infinite values
    and null classes are left out; a feature without points left has no row.
    """
    values = written(in_steps(long, bits), "values")
    found = written(kth_distances(values, k, buckets), "distances")
    reach = F.greatest(F.col("r") - 1, F.lit(0))
    asked = found.select("feature", "y", "v", F.col("n").alias("w"), F.explode(F.array(F.struct((F.col("v") + reach).alias("t"), F.lit(1).alias("sign")), F.struct((F.col("v") - reach - 1).alias("t"), F.lit(-1).alias("sign")))).alias("q"))
    events = found.groupBy("feature", F.col("v").alias("t")).agg(F.sum("n").alias("n")).selectExpr("feature", "t", "n", "0 as sign", "cast(null as bigint) as v", "cast(null as bigint) as w").withColumn("y", F.lit(None).cast(values.schema["y"].dataType))
    events = events.unionByName(asked.select("feature", F.col("q.t").alias("t"), F.lit(0).cast("bigint").alias("n"), F.col("q.sign").alias("sign"), "v", "w", "y"))
    events = written(events.withColumn("asks", F.abs("sign")), "events")
    totals = prefix_sums(events, ["feature"], ["t", "asks"], {"upto": "n"}, buckets=buckets).where("asks = 1")
    inside = totals.groupBy("feature", "y", "v").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"), F.max("w").alias("w"))
    spread = inside.groupBy("feature").agg(F.sum(F.col("w") * digamma(F.col("m"))).alias("inside"))
    by_class = found.groupBy("feature", "y").agg(F.sum("n").alias("nc"), F.max("k").alias("k"))
    sums = by_class.groupBy("feature").agg(F.sum("nc").alias("n"), F.sum(F.col("nc") * (digamma(F.col("k")) - digamma(F.col("nc")))).alias("classes"))
    mi = digamma(F.col("n")) + (F.col("classes") - F.col("inside")) / F.col("n")
    out = written(sums.join(spread, "feature").select("feature", F.greatest(mi, F.lit(0.0)).alias("mi")), "mi")
    dropped(values, found, events)
    return out
