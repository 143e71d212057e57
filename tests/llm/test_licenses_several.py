import itertools

from riskloom.llm.licenses import TEMPLATES, scan_text

FIRST = [(name, ts[0]) for name, ts in TEMPLATES.items()]


def found(text):
    return [(x[2], text[x[0] : x[1]]) for x in scan_text(text)]


def test_two_notices_of_one_block_give_a_row_each():
    for (one, a), (two, b) in itertools.permutations(FIRST, 2):
        for between in (" ", "\n"):
            assert [x for x, _ in found(a + between + b)] == [one, two], (a, b)


def test_spans_of_neighbours():
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    assert found(f"Intro.\n{mit}\n{apache}\nEnd") == [("MIT", mit), ("Apache-2.0", apache)]
    assert found(f"{mit} {apache} {mit}") == [("MIT", mit), ("Apache-2.0", apache), ("MIT", mit)]


def test_a_list_of_all_notices():
    text = "\n".join(t for _, t in FIRST)
    assert found(text) == FIRST
