import random

import numpy as np

from riskloom.llm.chroma import FILTERS, LEAST_OVERLAP, MOST_ERRORS, aligned, bit_errors, chroma_of_bytes, chroma_of_samples, fingerprint


def test_filters_lie_in_the_window():
    assert len(FILTERS) == 16 and all(y + h <= 12 and w <= 16 for _, y, h, w in FILTERS)


def test_tones_have_their_pitch_class():
    rate = 11025
    t = np.arange(rate * 2) / rate
    for semitones in range(12):
        chroma = chroma_of_samples(np.sin(2 * np.pi * 440 * 2 ** (semitones / 12) * t), rate)
        assert (chroma.argmax(axis=1) == semitones).all()
    assert fingerprint(chroma_of_samples(np.zeros(100), rate)).tolist() == []


def test_noise_changes_few_bits():
    rng = np.random.default_rng(1)
    rate = 11025
    notes = 440 * 2 ** (rng.integers(-12, 12, 60) / 12)
    clean = np.concatenate([np.sin(2 * np.pi * f * np.arange(rate // 3) / rate) for f in notes])
    a = fingerprint(chroma_of_samples(clean, rate))
    b = fingerprint(chroma_of_samples(clean + 0.05 * rng.standard_normal(len(clean)), rate))
    other = np.concatenate([np.sin(2 * np.pi * f * np.arange(rate // 3) / rate) for f in 440 * 2 ** (rng.integers(-12, 12, 60) / 12)])
    c = fingerprint(chroma_of_samples(other, rate))
    assert bit_errors(a, b, 0)[1] < 0.1 < 0.25 < bit_errors(a, c, 0)[1]


def test_integral_image_equals_plain_sums():
    from riskloom.llm.chroma import LEVELS, SMOOTH

    rng = np.random.default_rng(2)
    chroma = rng.random((40, 12))
    n = 36
    image = np.array([sum(w * chroma[t + i] for i, w in enumerate(SMOOTH)) for t in range(n)])
    image /= np.sqrt((image**2).sum(axis=1, keepdims=True))
    got = fingerprint(chroma)
    for t in range(n - 15):
        value = 0
        for kind, y, h, w in FILTERS:
            block = image[t : t + w, y : y + h]
            sign = np.ones((w, h))
            if kind == 0:
                sign[:, h // 2 :] = -1
            elif kind == 1:
                sign[w // 2 :] = -1
            elif kind == 2:
                sign[w // 2 :, : h // 2] = -1
                sign[: w // 2, h // 2 :] = -1
            else:
                sign[: w // 4] = -1
                sign[w // 4 + w // 2 :] = -1
            plus, minus = block[sign > 0].sum(), block[sign < 0].sum()
            level = sum(4 * np.log((1 + plus) / (1 + minus)) >= x for x in LEVELS)
            value = value << 2 | level ^ level >> 1
        assert value == got[t]


def test_aligned_recordings(spark):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    song, hot = say(1200), say(800)
    rows = [(1, song), (2, song), (3, song[400:]), (4, song[:600]), (5, say(900)), (6, None), (7, ""), (8, "ab"), (9, "x" * 300), (10, say(300_000))]
    rows += [(100 + i, hot + say(100)) for i in range(60)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "rec bigint, sound string, ints string")
    got = {r.rec: r for r in aligned(df).collect()}
    assert len(got) == len(rows) and got[1].class_id == got[2].class_id
    assert got[6].n_frames == got[7].n_frames == got[8].n_frames == 0 and got[6].n_links == 0
    assert len({got[i].group_id for i in (1, 2, 3, 4)}) == 1 and got[5].n_links == 0 and got[10].n_links == 0
    assert len({got[100 + i].group_id for i in range(60)}) == 1
    by_class = {r.class_id: dict(rows)[i] for i, r in got.items() if r.n_frames}
    prints = {c: fingerprint(chroma_of_bytes(np.frombuffer(t.encode(), np.uint8))) for c, t in by_class.items()}
    for i, r in got.items():
        if r.match_id is not None:  # as brute force over the offset says
            n, e = bit_errors(prints[r.match_id], prints[r.class_id], r.offset)
            assert n == r.overlap >= LEAST_OVERLAP and abs(e - r.bit_error) < 1e-6 and e <= MOST_ERRORS
    if got[3].match_id == got[1].class_id:
        assert got[3].offset == 100
    assert aligned(df.limit(0)).collect() == []
