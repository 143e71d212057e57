import random
import zlib

import numpy as np
import pytest

from riskloom.llm.packing import Schedule, pack
from riskloom.llm.queries import tokenizer_path
from riskloom.llm.tokens import PieceEncoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_piece_encoder_equals_library(tokenizer):
    rng = random.Random(3)
    parts = ["the", "The", "'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "12", "3", "!", "?!", "...", " ", "　", "日本", "😀", "\U0001d400", "<|endoftext|>", "́", "a", "d", "ve", "\0", "\r\n", "²", "½", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "\n", "it's they'll 'tis 've", "!'s", "\n's", " 's"]
    ids, counts = PieceEncoder(tokenizer_path(), most=500).encode(texts)
    ends = np.cumsum(counts)
    for t, e, c in zip(texts, ends, counts):
        assert ids[e - c : e].tolist() == whole(tokenizer, t), repr(t)


def check(rows, docs, tokenizer, window=1024):
    by_row, by_seq = {}, {}
    for r in rows:
        by_row.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, texts in docs.items():
        want = sorted(whole(tokenizer, t) for t in texts)
        got = sorted(by_row[doc_id], key=lambda r: r.start)
        assert sum(r.length for r in got) == sum(map(len, want))
        if len(want) == 1:
            at = 0
            for r in got:
                assert r.start == at and r.doc_tokens == len(want[0])
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(want[0][r.start : at], "<u4").tobytes())
    pad = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    assert pad == 0 and sorted(by_seq) == list(range(len(by_seq)))


def test_pack_round_trip(spark, tokenizer):
    rng = random.Random(5)
    words = "alpha beta gamma delta it's 12 é\n".split(" ")
    docs = {i: [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400])))] for i in range(300)}
    docs |= {300: [None], 301: [""], 302: ["x " * 30_000]}
    rows = [(i, t[0], None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}", "extra") for i, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, ids string").repartition(5)
    check(pack(df, tokenizer_path()).collect(), docs, tokenizer)
    twice = pack(df.union(df), tokenizer_path(), max_queues=3).collect()
    check(twice, {i: t * 2 for i, t in docs.items()}, tokenizer)


def test_a_mixture_binds_in_every_window(spark, tokenizer):
    """Two named sources hold their shares of each window, the others the rest in proportion, until a queue runs dry."""
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.random()) for _ in range(60)), "big" if i % 2 else f"s{i % 6}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = pack(df, tokenizer_path(), mixture={"big": 0.25, "s2": 0.5}, max_queues=1).collect()
    check(got, {i: [t] for i, t, _ in rows}, tokenizer)
    ends = {}
    for r in got:
        ends[r.source] = max(ends.get(r.source, 0), r.sequence_id)
    for w in range(min(ends.values())):
        ids = {}
        for r in got:
            if r.sequence_id == w:
                ids[r.source] = ids.get(r.source, 0) + r.length
        assert abs(ids["big"] - 256) <= 128 and abs(ids["s2"] - 512) <= 128 and sum(ids.values()) == 1024


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert pack(df, tokenizer_path()).collect() == []


def test_schedule_keeps_mixture_and_carries_deficits():
    totals, weights = [70_000, 20_000, 10_000], [700_000, 200_000, 100_000]
    s = Schedule(totals, weights, 64, 1024)
    seen = np.full(sum(totals), -1)
    for q, t in enumerate(totals):
        p = s.pieces(np.array([q]), np.array([0]), np.array([t]))
        for seq, off, n in zip(p["sequence_id"], p["offset"], p["length"]):
            _, first, _ = s.sequence(np.array([seq * 1024])) if seq < s.full else (0, s.tail[seq - s.full : seq - s.full + 1], 0)
            seen[first[0] + off : first[0] + off + n] = q
    assert (seen >= 0).all()
    share = np.array(weights) / sum(weights)
    for w in range(1, s.full):
        for q in range(3):
            assert abs((seen[: w * 1024] == q).sum() - share[q] * w * 1024) <= 2 * 64


def test_schedule_with_other_targets_serves_every_id():
    s = Schedule([500, 3000, 0, 1], [900_000, 50_000, 1, 50_000], 64, 256)
    places = []
    for q, t in enumerate(s.totals):
        if t:
            p = s.pieces(np.array([q]), np.array([0]), np.array([t]))
            places += [(a, b, n) for a, b, n in zip(p["sequence_id"], p["offset"], p["length"])]
    assert sum(n for *_, n in places) == s.total
    used = sorted((a, b, b + n) for a, b, n in places)
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(used, used[1:]))
