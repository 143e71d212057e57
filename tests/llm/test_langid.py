import random

import pytest

from riskloom.llm.langid import accepted, document_rows, fit_text_model, identify, labelled_documents, page_rows

SYLLABLES = {"en": "the and ing tion her wh ou st ly".split(), "de": "der sch ung ein keit ü ß ver lich".split(), "fr": "eau que ment é ou les ai tre è".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", "fr"])
        rows.append((i, say(rng, lang, rng.choice([3, 10, 60])), lang, lang, f"{'hot' if i % 3 else lang + str(i % 5)}", "x"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, truth string, source string, posterior string")


def test_held_out_accuracy(spark, table):
    model = fit_text_model(labelled_documents(table.where("doc_id % 2 = 0")))
    assert model.languages[0] == "en" and set(model.languages) == {"en", "de", "fr"}
    test = table.where("doc_id % 2 = 1")
    blind = test.withColumn("lang", test.lang.substr(1, 0))  # nothing declared
    got = {r.doc_id: r for r in identify(document_rows(blind), model).collect()}
    truth = {r.doc_id: r.truth for r in test.collect()}
    assert got.keys() == truth.keys()
    assert sum(got[i].lang == t for i, t in truth.items()) / len(truth) > 0.97
    assert not any(got[i].rejected for i in truth)


def test_evidence_is_fused(spark, table):
    model = fit_text_model(labelled_documents(table))
    base = table.select("doc_id", "text", table.lang.alias("declared"), "source")
    rows = base.select("doc_id", "text", "declared", base.source.alias("host"))
    odd = spark.createDataFrame([(9001, "eau", "fr", "fr1"), (9002, None, "fr", "fr1"), (9003, "", None, None), (9004, "12 34 !", "en", ""), (9005, "the " * 50_000, "de", "de.example.de")], "doc_id bigint, text string, declared string, host string")
    got = {r.doc_id: r for r in identify(rows.union(odd), model).collect()}
    assert got[9001].lang == "fr"
    assert got[9002].rejected and got[9002].lang == "und" and got[9003].rejected and got[9004].rejected
    assert got[9005].lang == "en"  # a long text outweighs its declaration and address
    again = identify(rows.limit(0), model)
    assert again.collect() == [] and again.columns == ["doc_id", "lang", "posterior", "text_lang", "n_grams", "rejected"]


def test_host_prior_and_declaration_decide_short_texts(spark, table):
    model = fit_text_model(labelled_documents(table))
    many = [(i, say(random.Random(i), "de", 20), "de", "a.example.de") for i in range(60)] + [(1000 + i, say(random.Random(i), "fr", 20), "fr", "b.example.fr") for i in range(60)]
    short = [(5000, "xqz", "de", "new.example.de"), (5001, "xqz", "fr", "b.example.fr")]
    df = spark.createDataFrame(many + short, "doc_id bigint, text string, declared string, host string")
    got = {r.doc_id: r.lang for r in identify(df, model).collect()}
    assert got[5000] == "de" and got[5001] == "fr"


def test_accepted_keeps_clean_documents(spark, table):
    junk = spark.createDataFrame([(7000, "%%% 123 ###", "en", "en", "hot", "x"), (7001, None, "en", "en", None, "x")], table.schema)
    kept = accepted(table.union(junk))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(900))
    assert accepted(table.limit(0)).collect() == []


def test_pages(spark, table):
    model = fit_text_model(labelled_documents(table))
    rng = random.Random(1)
    page = f"<html lang='de-DE'><body><nav>the and</nav><article><p>{say(rng, 'de', 40)}</p></article></body></html>"
    df = spark.createDataFrame([(1, "https://a.example.de/x", page), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in identify(page_rows(df), model).collect()}
    assert got[1].lang == "de" and got[2].rejected
    with pytest.raises(ValueError):
        fit_text_model(labelled_documents(table.limit(0)))


def test_posteriors_equal_plain_python(spark, table):
    """All four kinds of evidence, added up row by row, with counts taken by loops."""
    import math
    from collections import Counter

    from riskloom.llm import langid as L

    model = fit_text_model(labelled_documents(table))
    hosts = ["a.example.de", "b.example.de", "c.example.fr", "d.org", "", None, "x.y.d.org"]
    rows = []
    for r in table.limit(200).collect():
        rows.append((r.doc_id, r.text if r.doc_id % 9 else "ei", [r.lang, "xx", None, "EN-us"][r.doc_id % 4], hosts[r.doc_id % 7]))
    rows.append((9999, "1 2 3", "de", "a.example.de"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, host string")
    got = {r.doc_id: r for r in identify(df, model).collect()}

    names = model.languages
    facts = []
    for i, text, said, host in rows:
        data = text.lower().encode()
        means, n = model.means(__import__("numpy").frombuffer(data, "uint8"), __import__("numpy").array([0, len(data)]))
        score = [float(m) * min(int(n[0]), L.MOST_GRAMS) * L.TEMPER for m in means[0]]
        said = (said or "").strip().split("-")[0].lower()
        host = (host or "").lower()
        parts = host.split(".")
        facts.append((i, int(n[0]), score, said if said in names else "none" if not said else "other", parts[-1] if len(parts) > 1 else "", ".".join(parts[-2:]) if len(parts) > 1 else host, host, score.index(max(score)) if n[0] else None))
    seen = [f for f in facts if f[7] is not None]
    by_lang = Counter(f[7] for f in seen)
    prior = [(by_lang[k] + L.SMOOTH) / (len(seen) + L.SMOOTH * len(names)) for k in range(len(names))]
    counts = {place: Counter((f[place], f[7]) for f in seen) for place in (3, 4, 5, 6)}
    kinds = max(2, len({f[4] for f in seen}) + 1)
    for i, n, score, said, suffix, domain, host, verdict in facts:
        total = []
        for k in range(len(names)):
            own, one = int(verdict == k), int(verdict is not None)
            of = lambda place, value: sum(c for (v, _), c in counts[place].items() if v == value)
            x = score[k]
            if of(3, said):
                x += math.log((counts[3][said, k] + L.SMOOTH) / (by_lang[k] + L.SMOOTH * (len(names) + 2)))
            if of(4, suffix):
                x += math.log((counts[4][suffix, k] + L.SMOOTH) / (by_lang[k] + L.SMOOTH * kinds))
            if of(6, host):
                p = (counts[5][domain, k] - own + L.STRENGTH * prior[k]) / (of(5, domain) - one + L.STRENGTH)
                x += math.log((counts[6][host, k] - own + L.STRENGTH * p) / (of(6, host) - one + L.STRENGTH))
            else:
                x += math.log(prior[k])
            total.append(x)
        best = max(total)
        want = 0.0 if not n else 1 / sum(math.exp(t - best) for t in total)
        assert abs(got[i].posterior - want) < 1e-9, (i, got[i], want)
        assert got[i].lang == ("und" if want < L.LEAST_POSTERIOR else names[total.index(best)])


def test_extra_columns_that_clash(spark, table):
    odd = table.withColumnRenamed("posterior", "row").withColumnsRenamed({"truth": "_row"})
    assert accepted(odd).count() == 900 and accepted(odd).columns == odd.columns
