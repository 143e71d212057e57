import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import suffixdedup
from riskloom.llm.suffixdedup import column_wise, deduplicated


def brute(docs, length):
    seen = Counter(t[p : p + length] for _, t in docs for p in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "xyz", "a", "\n", "ß ", "q"])
    passages = ["".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    docs = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            if rng.random() < 0.4:  # a near copy
                k = rng.randrange(len(p))
                p = p[:k] + word() + p[k + 1 :]
            parts += ["".join(word() for _ in range(rng.randint(0, 15))), p]
        docs.append("".join(parts))
    return docs + ["a" * 200, "", None, "abc" * 30, "x" * 19, "".join(word() for _ in range(3000)), docs[0], docs[0]]


@pytest.mark.parametrize("batch", [suffixdedup.BATCH, 3])
def test_equal_to_brute_force(spark, batch):
    docs = list(enumerate(corpus(3)))
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, n_bytes int").repartition(5)
    got = deduplicated(df, length=20, gram=5, batch=batch)
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert rows == brute([(i, (t or "").encode()) for i, t in docs], 20)


def test_full_length_with_long_text_and_copies(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(700)
    docs = [(1, text(300) + passage), (2, passage[100:] + text(900)), (3, text(2000)), (4, passage[:420]), (5, passage[:399]), (6, text(1_200_000) + "#" + passage[50:650])]
    docs += [(7, docs[2][1]), (8, docs[2][1]), (8, docs[2][1])]
    got = deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    want = brute([(i, t.encode()) for i, t in docs if i != 6] + [(6, passage[50:650].encode())], 400)
    for r, w in zip([r for r in rows if r[0] != 6], [w for w in want if w[0] != 6]):
        assert r == w
    six = next(r for r in rows if r[0] == 6)
    assert six[1:4] == (1_200_601, 600, 1)
    assert deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string").limit(0)).collect() == []


def test_column_wise_construction():
    rng = random.Random(5)
    length, gram, reach = 12, 4, 8
    rows = sorted((rng.randint(0, 3), rng.randint(0, reach), bytes(rng.choice(b"ab") for _ in range(30))) for _ in range(300))
    strings, shifts = [], []
    for _, shift, s in rows:
        n = rng.randint(length, shift + reach + 2 * gram) if shift + reach + 2 * gram >= length else length
        strings.append(s[: min(n, shift + length)] if shift + length >= length else s[:length])
        shifts.append(shift)
    found = column_wise(strings, np.array(shifts), np.array([g for g, *_ in rows]), length, gram)
    windows = Counter()
    at = [[(g, p + reach - sh, s[p : p + length]) for p in range(len(s) - length + 1) if p + reach - sh <= reach] for (g, _, _), sh, s in zip(rows, shifts, strings)]
    for ws in at:
        windows.update(ws)
    for i, ws in enumerate(at):
        assert {w[1] for w in ws if windows[w] > 1} == set(np.flatnonzero(found[i]).tolist())


def brute_passages(docs, n):
    """Words of each document that n words in a row cover which another document has too, and the runs they make."""
    words = [(i, (t or "").lower().split()) for i, t in docs]
    seen = {}
    for k, (i, w) in enumerate(words):
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p : p + n]), set()).add((i, docs[k][1]))
    out = []
    for i, w in words:
        hit = np.zeros(len(w) + 1, bool)
        for p in range(len(w) - n + 1):
            if len(seen[tuple(w[p : p + n])]) > 1:
                hit[p : p + n] = True
        out.append((i, int((hit[1:] & ~hit[:-1]).sum() + hit[0]), int(hit.sum())))
    return sorted(out)


@pytest.mark.parametrize("batch", [suffixdedup.BATCH, 3])
def test_passages_across_documents(spark, batch):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passages = [text(n) for n in (9, 10, 11, 14, 40)]
    docs = []
    for i in range(80):
        w = text(rng.randint(0, 25))
        for _ in range(rng.randint(0, 2)):
            w += rng.choice(passages) + text(rng.randint(0, 12))
        docs.append((i, " ".join(w)))
    own = text(12)
    docs += [(80, " ".join(own + text(5) + own)), (81, " ".join(passages[3]).upper()), (82, None), (83, docs[0][1]), (0, docs[0][1]), (84, " ".join(["a"] * 60))]
    got = deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), batch=batch, passage_words=10).collect()
    assert sorted((r.doc_id, r.n_passages, r.n_passage_words) for r in got) == brute_passages(docs, 10)
