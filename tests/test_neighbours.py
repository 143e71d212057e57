import math
import random

import numpy as np
import pytest

from riskloom.operators.neighbours import in_steps, mi_knn


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(values, k):
    """Mutual information of integers v and classes y, every pair compared."""
    by_class = {}
    for v, y in values:
        by_class.setdefault(y, []).append(v)
    points = [(v, y) for v, y in values if len(by_class[y]) > 1]
    if not points:
        return None
    everything = np.array([v for v, _ in points])
    total = 0.0
    for v, y in points:
        own = np.sort(np.abs(np.array(by_class[y]) - v))[1:]
        kc = min(k, len(own))
        r = own[kc - 1]
        m = int((np.abs(everything - v) < r).sum()) if r else int((everything == v).sum())
        total += psi(kc) - psi(len(by_class[y])) - psi(m)
    return max(0.0, psi(len(points)) + total / len(points))


@pytest.mark.parametrize("k, buckets", [(3, None), (1, 7), (5, 40)])
def test_equal_to_every_pair(spark, k, buckets):
    rng = random.Random(k)
    features = {
        "ints": [(rng.randrange(40), rng.randrange(2)) for _ in range(300)],
        "apart": [(1000 * y + rng.randrange(100), y) for y in (0, 1) for _ in range(60)],
        "wide": [(rng.randrange(10**9), rng.choice([0, 0, 0, 1])) for _ in range(250)],
        "one value": [(7, i % 2) for i in range(20)],
        "lonely class": [(i * i, 2 if i == 5 else 0) for i in range(12)],
        "two": [(3, 1), (9, 1)],
        "none": [(1, 0), (2, 1)],
    }
    rows = [(f, float(v), y) for f, vs in features.items() for v, y in vs] + [("ints", None, 1), ("ints", float("nan"), 1), ("ints", float("inf"), 0), ("ints", 3.0, None)]
    long = spark.createDataFrame(rows, "feature string, x double, y int").repartition(4)
    got = {r["feature"]: r["mi"] for r in mi_knn(long, k, buckets=buckets).collect()}
    want = {f: plain(vs, k) for f, vs in features.items() if plain(vs, k) is not None}
    assert got.keys() == want.keys()
    for f in want:
        assert math.isclose(got[f], want[f], rel_tol=1e-8, abs_tol=1e-9), f
    assert want["apart"] > (0.6 if k >= 3 else 0)


def test_steps_and_no_rows(spark):
    long = spark.createDataFrame([("a", 0.1, 1), ("a", 0.1, 1), ("a", 0.7, 0)], "feature string, x double, y int")
    assert sorted(tuple(r) for r in in_steps(long, 4).collect()) == [("a", 0, 19, 1), ("a", 1, 0, 2)]  # steps of 1/32 in a range of 0.6
    assert mi_knn(long.limit(0)).collect() == []
