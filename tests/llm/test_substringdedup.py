import hashlib
import random
import re
from collections import Counter

import pytest

from riskloom.llm.substringdedup import COVERS, cover_of, deduplicated


def brute(docs, length):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    seen = Counter(tuple(w[p : p + length]) for _, w in texts for p in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def rows(got):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect())


def corpus(seed, vocabulary, longest):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    passages = [[word() for _ in range(rng.randint(5, longest))] for _ in range(10)]
    docs = []
    for _ in range(100):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:  # a near copy
                p[rng.randrange(len(p))] = word()
            words += [word() for _ in range(rng.randint(0, 9))] + p[rng.randint(0, 3) :]
        docs.append("".join(w + rng.choice([" ", "\n", " \t", "  ", "\x0b"]) for w in words))
    return docs


def test_covers_have_every_difference():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    for length in range(1, 60):
        assert cover_of(length)[0] <= length


@pytest.mark.parametrize("length, vocabulary, longest", [(6, ["a", "b", "A", "é"], 30), (10, [f"w{i}" for i in range(40)], 40), (35, [f"w{i}" for i in range(900)], 120), (1, ["x", "y", "zz"], 6), (2, [f"v{i}" for i in range(30)], 9)])
def test_equal_to_brute_force(spark, length, vocabulary, longest):
    docs = corpus(length, vocabulary, longest)
    docs += ["a " * (3 * length), "", None, " \n", "b c " * (2 * length), " ".join(vocabulary * 3)[:5000], docs[0], docs[0], " x".join(docs[1].split(" "))]
    docs = list(enumerate(docs))
    docs += [(3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (None, docs[5][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, anchor string").repartition(5)
    assert rows(deduplicated(df, length)) == brute(docs, length)


def test_very_long_text_and_no_rows(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(50))
    long = " ".join(f"q{rng.randrange(10**7)}" for _ in range(420_000)) + "\n" + "z" * 1_300_000 + " " + passage + " end"
    docs = [(1, long), (2, "head " + passage), (3, passage[: len(passage) // 2])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(deduplicated(df)) == brute(docs, 35)
    assert deduplicated(df.limit(0)).collect() == []
