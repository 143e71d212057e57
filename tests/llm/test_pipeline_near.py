import itertools
import random

import corpus_pipeline


def shingles(text, size):
    w = text.split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b, size):
    a, b = shingles(a, size), shingles(b, size)
    return len(a & b) / len(a | b) if a and b else 0.0


def test_near_stage_equals_brute_force_of_five_words_and_80_percent(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 20, 60, 150, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy + [rng.choice(vocab) for _ in range(rng.randint(0, len(base) // 4))]))
    rng.shuffle(texts)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    missed_by_op4 = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j], 5) >= 0.8:
            missed_by_op4 += jaccard(texts[i], texts[j], 4) < 0.85
            lo, hi = sorted((find(i), find(j)))
            up[hi] = lo
    assert missed_by_op4 > 5
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == {i for i in range(len(texts)) if find(i) == i}
