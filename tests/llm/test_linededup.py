import random
import re

import pytest

from riskloom.llm.linededup import deduplicated


def brute(docs):
    """Rows in order of doc_id; each line against every earlier one."""
    seen, out = [], []
    for i, t in docs:
        kept = []
        lines = (t or "").split("\n")
        for line in lines:
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w)
            if not any(s and 5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["the"] * 30 + ["of"] * 15 + ["é", "É"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 12, 14, 20, 33, 90]))] for _ in range(150)]
    docs = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            b = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if b:
                    b[rng.randrange(len(b))] = rng.choice(vocab)
            lines.append("  ".join(b).upper() if rng.random() < 0.2 else " ".join(b))
        docs.append("\n".join(lines))
    hub = [f"h{i}" for i in range(30)]
    for i in range(90):  # a large group of near copies of one line
        c = list(hub)
        for _ in range(rng.choice([1, 1, 2, 4])):
            c[rng.randrange(30)] = f"z{i}"
        docs.append(" ".join(c))
    docs += [None, "", "\n\n", "a b c d\n\na b c d\n\n", " \t", " ".join(f"long{i}" for i in range(70_000))]
    return docs


@pytest.mark.parametrize("broadcast", [500_000, -1])
def test_equal_to_brute_force(spark, broadcast):
    docs = list(enumerate(corpus(4)))
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in docs], "doc_id bigint, text string, ln string, n_lines int").repartition(5)
    got = deduplicated(df, broadcast)
    assert got.columns == ["doc_id", "text", "ln", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute(docs)
    assert not [x for x in got._jdf.queryExecution().toString().split() if "Python" in x or "Arrow" in x]


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two three\nfour"), (1, "one two three\nfour"), (None, "four"), (1, "other")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.text, r.n_removed) for r in deduplicated(df).collect())
    assert got == [(-1, "four", 0), (1, "", 2), (1, "one two three", 1), (1, "other", 0)]
    assert deduplicated(df.limit(0)).collect() == []


def test_keys_are_dealt_in_parts(spark, monkeypatch):
    """No scratch table or shuffle holds the listed lines of all keys."""
    from riskloom.llm import linededup

    parts, put = [], linededup.written

    def counted(df, what):
        out = put(df, what)
        if what == "lines-shared":
            parts.append(out.count())
        return out

    monkeypatch.setattr(linededup, "written", counted)
    docs = list(enumerate(corpus(5)))
    got = deduplicated(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == brute(docs)
    assert len(parts) == linededup.PARTS and max(parts) < sum(parts) / 2
