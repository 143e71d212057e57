import random

import numpy as np

from riskloom.llm.chroma import LEAST_OVERLAP, MOST_ERRORS, aligned, bit_errors, chroma_of_bytes, fingerprint


def test_every_pair_that_aligns_is_linked(spark, monkeypatch):
    monkeypatch.setattr("riskloom.llm.chroma.MARKS_A_PART", 2)  # several parts a key
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    jingle, song = say(240), say(1600)
    rows = [(i, jingle + say(1400)) for i in range(5)]  # share a key, but too few frames to align
    rows += [(5 + i, jingle + song[: 800 + 100 * i] + say(80)) for i in range(6)]
    got = {r.rec: r for r in aligned(spark.createDataFrame(rows, "rec bigint, sound string")).collect()}
    prints = {i: fingerprint(chroma_of_bytes(np.frombuffer(t.encode(), np.uint8))) for i, t in rows}
    links = {i: set() for i, _ in rows}
    for i in links:  # brute force over all pairs and offsets
        for j in links:
            if i < j and any(n >= LEAST_OVERLAP and e <= MOST_ERRORS for at in range(-len(prints[j]), len(prints[i])) for n, e in [bit_errors(prints[i], prints[j], at)]):
                links[i].add(j)
                links[j].add(i)
    assert all(len(links[i]) == 5 for i in range(5, 11)) and not any(links[i] for i in range(5))
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert len({got[i].group_id for i in range(5, 11)}) == 1
    assert all(got[i].offset == 0 for i in range(5, 11))
