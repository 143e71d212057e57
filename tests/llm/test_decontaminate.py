import random
import re
import time

import numpy as np

from riskloom.llm.decontaminate import MASKS, MIN_SHARE, MIN_WORDS, best_segment, contaminated, decontaminated


def plain(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """Every pair, every diagonal."""
    out = {}
    for d, t in docs:
        a = plain(t)
        for i, u in items:
            b = plain(u)
            for s in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -s), min(len(b), len(a) - s)
                best = run = n = kept = 0
                for k in range(lo, hi):
                    same = a[k + s] == b[k]
                    run, n = (run + 1, n + 1) if same else (run - 2, n)
                    if run < 0:
                        run, n = 0, 0
                    if run > best:
                        best, kept = run, n
                if len(b) >= 3 and (kept >= MIN_WORDS or kept / len(b) >= MIN_SHARE):
                    out[d, i] = max(out.get((d, i), 0), kept)
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([2, 3, 6, 15, 30, 50])))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(150):
        w = text(rng.choice([0, 10, 80]))
        if d % 2:
            p = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p))] = "other"
            k = rng.randint(0, len(w))
            w[k:k] = p
        docs.append((d, (" " if d % 3 else ", ").join(w).upper() if d % 5 == 0 else " ".join(w)))
    docs += [(150, None), (151, ""), (152, " ".join(text(40_000)))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.n_matches for r in contaminated(df, bench, block_chars=900).collect()}
    want = brute([x for x in docs if x[0] != 152], items)
    assert {k: v for k, v in got.items() if k[0] != 152} == want
    kept = {r.doc_id for r in decontaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminated(df, bench).columns == df.columns


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id bigint, text string")
    bench = df.withColumnRenamed("doc_id", "item_id")
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []
    assert contaminated(df.union(df), bench).count() == 2


def test_masks_hit_every_accepted_overlap():
    for size in range(5, 18):
        for x in range(1 << size):
            same = np.array([x >> i & 1 for i in range(size)], bool)
            if same.sum() < min(MIN_WORDS, MIN_SHARE * size):
                continue
            _, _, n = best_segment(same)
            if n >= MIN_WORDS or n / size >= MIN_SHARE:
                assert any(same[[i + k for k in m]].all() for m in MASKS for i in range(size - m[-1])), same


def test_substituted_words_and_junk(spark):
    rng = random.Random(3)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, text(60)) for i in range(40)]
    docs = []
    for i, b in items:
        w = list(b)
        w[3::4] = [f"new{k}" for k in range(len(w[3::4]))]  # every fourth word
        docs.append((i, " ".join(text(30) + w + text(30))))
    docs += [(100, "spam " * 8000), (101, " ".join(text(500)))]
    items += [(50, ["spam"] * 300)]
    bench = spark.createDataFrame([(i, " ".join(b)) for i, b in items], "item_id bigint, text string")
    began = time.time()
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {(i, i) for i in range(40)} | {(100, 50)}
    assert time.time() - began < 120
