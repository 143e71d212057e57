import random

from riskloom.llm import partenum


def test_large_texts_that_cannot_link_are_not_fetched(spark, monkeypatch):
    """Texts with a passage in common share signatures and fill a sketch of fixed size; near copies on both sides of a wide sketch's doubling still link."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passage = words(1500)
    docs = [" ".join(passage + words(3000)) for _ in range(5)]
    near = words(4200)
    docs += [" ".join(near), " ".join(near[:4000]), " ".join(near + words(300))]
    fetched, put = [], partenum.written

    def counted(df, what):
        out = put(df, what)
        if what == "pairs":
            fetched.append(out.count())
        return out

    monkeypatch.setattr(partenum, "written", counted)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id) for r in partenum.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 5)]
    assert sum(fetched) <= 3
