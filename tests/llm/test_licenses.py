import random

from riskloom.llm.licenses import TEMPLATES, candidate_blocks, judged, scan


def test_every_template_is_found_whole():
    for name, texts in TEMPLATES.items():
        for t in texts:
            found = judged(t)
            assert found is not None and found[0] == name and found[2] == 1.0 and found[3] == 0, (name, t, found)


def test_wording_decides():
    assert judged("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0"
    assert judged("Licensed under CC BY 4.0.")[0] == "CC-BY-4.0"
    name, _, common, n, diff = judged("This work is licensed under the terms of the GNU General Public License, version 3.")
    assert name == "GPL-3.0" and common == 1.0 and n == 1 and "the terms of" in diff
    assert judged("A driving license is required by the state.") is None


def test_scan(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["ating", "the", "onst", "here."]) for _ in range(n))
    flat = [(name, t) for name, ts in TEMPLATES.items() for t in ts]
    docs, want = [], set()
    for i in range(100):
        lines = [prose(rng.randint(1, 30)) for _ in range(4)]
        if i % 2:
            name, t = rng.choice(flat)
            lines.insert(rng.randint(0, 4), t)
            text = "\n".join(lines)
            want.add((i, text.index(t), text.index(t) + len(t), name))
        docs.append((i, "\n".join(lines)))
    docs += [(200, None), (201, ""), (202, prose(60_000) + "\nReleased under the MIT License."), (203, "My license plate."), (204, "Über. Released under the MIT License. More.")]
    got = scan(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, start int"))
    rows = {(r.doc_id, r.start, r.end, r.license) for r in got.collect()}
    assert {r for r in rows if r[0] < 200} == want
    assert {(r[0], r[3]) for r in rows if r[0] >= 200} == {(202, "MIT"), (204, "MIT")}
    assert scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_blocks_are_sentences_with_hints():
    t = "First one. Licensed under CC BY 4.0. Last one.\nnothing"
    assert [t[a:b] for a, b in candidate_blocks(t)] == ["Licensed under CC BY 4.0."]
