import random
import re

import pytest

import corpus_pipeline
from riskloom.llm.queries import tokenizer_path
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_linededup import brute as dedup_lines
from tests.llm.test_partenum import brute as groups

WORDS = {"en": "the and ing of to that was here with from", "de": "der die und ein ist nicht schön über mit von"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + str(rng.randint(0, 400)) for _ in range(n))
    items = [(i, text("en", 25)) for i in range(6)]
    docs = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        docs.append([i, "\n".join(text(lang, rng.choice([6, 20, 60])) for _ in range(rng.randint(1, 4))), lang])
    for i in range(160, 200):  # near copies whose lines all differ enough
        old = docs[i - 160][1].split("\n")
        docs.append([i, " ".join(old), docs[i - 160][2]])
    for i in range(200, 220):
        docs.append([i, text("en", 30) + "\n" + rng.choice(items)[1], "en"])
    docs += [[220, None, "en"], [221, "", "en"], [222, "12 34", "en"], [223, docs[0][1], docs[0][2]]]
    where = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, f"s{i % 5}", len(t or "")) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, items


def test_stages_equal_brute_force(spark, tables):
    sf_dir, docs, items = tables
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {i: t for i, t, _ in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = stage(spark, now, sf_dir)
        assert now.columns == before.columns
        got = {r.doc_id: r for r in now.collect()}
        if name == "language_id":
            want = {i: t for i, t in want.items() if re.search("[a-z]", t or "")}
        elif name == "line_dedup":
            want = {i: t for i, t, *_ in dedup_lines(sorted(want.items()))}
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "ngram_jaccard":
            keep = {i for i, _, c in groups(sorted(want.items())) if i == c}
            want = {i: t for i, t in want.items() if i in keep}
        else:
            bad = {d for d, _ in overlaps(sorted(want.items()), items)}
            want = {i: t for i, t in want.items() if i not in bad}
            assert bad
        assert {i: r.text for i, r in got.items()} == want, name
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(want)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in packed)
    assert sorted((r.doc_id, r.doc_tokens) for r in whole if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in packed if r.start == 0)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: r.doc_tokens for r in whole} == {i: len(t.encode(x).ids) + 1 for i, x in want.items()}
