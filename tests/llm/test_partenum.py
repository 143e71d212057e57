import itertools
import random
import re

import numpy as np

from riskloom.llm.common import raw_strings
from riskloom.llm.partenum import near_duplicates, shingle_sets, signatures


def brute_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def brute(docs):
    ids = [i for i, _ in docs]
    sets = [brute_set(t) for _, t in docs]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return sorted((ids[i], len(sets[i]), min(groups[find(i)])) for i in range(len(ids)))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "Ab", "aB", "x y"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 12, 30, 80, 300]))] for _ in range(n)]
    docs = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                if c:
                    c[rng.randrange(len(c))] = rng.choice(vocab)
            docs.append("\n".join(c) if rng.random() < 0.5 else " ".join(c).upper())
    hub = [f"h{i}" for i in range(120)]
    for i in range(40):  # a large group of near copies round one text
        c = list(hub)
        c[rng.randrange(120)] = f"z{i}"
        c[rng.randrange(120)] = f"y{i}"
        docs.append(" ".join(c))
    docs += [" ".join(hub), None, "", " \t\n", " ", " ".join(f"long{i}" for i in range(20_000))]
    rng.shuffle(docs)
    return [(7 * i + 1, d) for i, d in enumerate(docs)]


def test_linked_sets_share_a_signature():
    rng = random.Random(9)
    for n in [*range(1, 40), 57, 100, 333, 1000]:
        for _ in range(12):
            a = [rng.getrandbits(60) for _ in range(n)]
            most = (15 * 2 * n) // 185
            d = rng.randint(0, most)
            out = rng.randint(0, d)
            b = a[out:] + [rng.getrandbits(60) for _ in range(d - out)]
            common, union = n - out, n + d - out
            if not b or 100 * common < 85 * union:
                continue
            sigs = []
            for s in (a, b):
                s = np.sort(np.array(s, np.uint64))
                sigs.append(set(signatures(np.zeros(len(s), np.int64), s, np.array([len(s)]))[1].tolist()))
            assert sigs[0] & sigs[1], (n, len(b), d)


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus(1, 90)
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, n bigint").repartition(6)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert got == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (1, 1), (2, 2)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_shingle_sets_of_each_text():
    import pyarrow as pa

    texts = [t for _, t in corpus(2, 40)]
    doc, key = shingle_sets(*raw_strings(pa.array(texts)))
    n = np.bincount(doc, minlength=len(texts))
    assert n.tolist() == [len(brute_set(t)) for t in texts]


def test_shared_and_missing_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, near = " ".join(words), "some other text of a few words", " ".join([*words, "more"])
    df = spark.createDataFrame([(5, a), (5, b), (7, near)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(df).collect()) == [(5, 5, 4), (5, 5, 57), (7, 5, 58)]
    df = spark.createDataFrame([(None, a), (7, near), (None, b), (None, None)], "doc_id bigint, text string")
    assert sorted((r.n_shingles, r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(0, None, None), (4, None, None), (57, None, 7), (58, 7, 7)]


def test_signatures_are_dealt_in_parts(spark):
    """The parts are disjoint and make up all signatures."""
    from pyspark.sql import functions as F

    from riskloom.llm.partenum import signed

    docs = spark.createDataFrame([(" ".join(f"w{i * j % 97}" for j in range(60)),) for i in range(1, 40)], "text string")
    pairs = lambda **deal: sorted(map(tuple, signed(docs, **deal).select("class", F.explode("sigs")).collect()))
    whole, parts = pairs(), [pairs(part=i, parts=3) for i in range(3)]
    assert all(parts) and sorted(sum(parts, [])) == whole
