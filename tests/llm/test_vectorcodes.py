import hashlib
import math
import random

import numpy as np
import pytest

from riskloom.llm.vectorcodes import BallTree, compressed


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) by comparing each part with each entry, in Python integers."""
    ok = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ok:
        return []
    size = len(ok[0][1])
    ok = [r for r in ok if len(r[1]) == size]
    cuts = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
    books = [[v[lo:hi] for _, v, _ in ok[:entries]] for lo, hi in cuts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, (lo, hi) in enumerate(cuts):
            groups = {}
            for _, v, _ in ok:
                groups.setdefault(near(v[lo:hi], books[p])[1], []).append(v[lo:hi])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in ok:
        found = [near(v[lo:hi], books[p]) for p, (lo, hi) in enumerate(cuts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((-1 if i is None else i, "".join(f"{c:02x}" for _, c in found), error, label))
    return sorted((i, code, error, by_label[label], sha) for i, code, error, label in out)


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, code string").repartition(4)


def vectors(seed, n, size):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(20)]
    f = lambda x: float(np.float32(x))
    return [(i, [f(x + rng.gauss(0, 0.05)) for x in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in rng.sample(range(10 * n), n)]


def test_equal_to_plain_search(spark):
    rows = vectors(1, 300, 64)
    rows += [(5000, None, 1), (5001, [None] + [0.5] * 63, 2), (5002, [float("nan")] + [0.5] * 63, 1), (5003, [float("inf")] * 64, None), (5004, [1.0] * 8, 1), (5005, [], 2)]
    rows += [(None, rows[0][1], 1), (rows[1][0], rows[2][1], 2), rows[3], rows[3]]
    assert got(compressed(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("size, n", [(8, 200), (20, 60), (5, 9), (64, 3)])
def test_other_sizes_ties_and_few_rows(spark, size, n):
    rng = random.Random(size)
    rows = [(i, [rng.choice([0.0, 1 / 4096, -1 / 4096, 0.25]) for _ in range(size)], rng.choice([1, None])) for i in range(n)]
    assert got(compressed(table(spark, rows))) == plain(rows)


def test_large_components_and_no_rows(spark):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    out = got(compressed(table(spark, rows)))
    assert [r[1:3] for r in out] == [("00" * 8, 0), ("01" * 8, 0), ("02" * 8, 0)]
    assert compressed(table(spark, rows).limit(0)).collect() == []
    assert compressed(table(spark, [(1, None, 1)])).collect() == []


def test_ball_tree_is_exact_and_skips():
    rng = np.random.default_rng(2)
    for entries, parts in [(rng.integers(-9, 9, (64, 3)), rng.integers(-12, 12, (3000, 3))), (rng.integers(-(2**26), 2**26, (256, 8)), rng.integers(-(2**26), 2**26, (500, 8))), (np.zeros((40, 2), int), rng.integers(-1, 2, (50, 2)))]:
        tree = BallTree(entries)
        code, away = tree.nearest(parts)
        d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (away == d.min(axis=1)).all()
    clustered = np.repeat(rng.integers(-(10**6), 10**6, (32, 8)), 8, axis=0) + rng.integers(-50, 50, (256, 8))
    tree = BallTree(clustered)
    tree.nearest(clustered[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 8)))
    assert tree.visits < 0.25 * 2000 * 256
