from riskloom.llm import linededup


def test_long_lines_that_cannot_match_are_not_compared_whole(spark, monkeypatch):
    """Thirty lines of 120 words that share 90, too few to match: 44 bits of sketch let all their pairs pass."""
    both = [f"c{i}" for i in range(90)]
    docs = [" ".join(both + [f"u{d}x{i}" for i in range(30)]) for d in range(30)]
    docs.append(docs[7] + " more")
    pairs, put = [], linededup.written

    def counted(df, what):
        out = put(df, what)
        if what == "line-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(linededup, "written", counted)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed) for r in linededup.deduplicated(df).collect())
    assert got == [(i, int(i == 30)) for i in range(31)]
    assert 1 <= sum(pairs) < 60
