import html
import random

from riskloom.llm.htmltree import extract, host_of, importance, main_text, style_features

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>'
    '<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy.</div>'
    '<div id="cookie-notice"><p>We use cookies</p></div><article><header><h1>Title &amp; more</h1></header><p><b>One  <i>two</i><br>three\n four<br><p>Next &eacute;&#x41;</p>'
    '<form><label>Mail</label><input></form><ul><li>a<li>b</ul><script>x</script><section class="comments"><p>first!</p></section></article>'
    '<aside>side</aside><div class="sidebar">more</div><footer>&copy; me</footer></body></html>'
)


def test_main_text_of_one_page():
    assert main_text(PAGE) == "Title & more\nOne two three four\nNext éA\na\nb"
    assert main_text("") == "" and main_text("plain < text &lt;b&gt;") == "plain < text <b>"
    assert main_text("<p>a<p>b<div>c") == "a\nb\nc"
    assert main_text("<script>never closed <p>x") == ""
    assert main_text("<body><main><p>in</p></main><p>out</p>") == "in"
    assert main_text("<p>a <span class='ad'>buy</span> b</p>") == "a b"
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_style_tree_takes_out_what_a_site_repeats(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(5))}</p>" for _ in range(3))
        host = "hot.example.com" if i % 3 else "b.example.org"
        rows.append((i, f"https://{host}/{i}", f"<body><div class=x1><p>Same words on every page</p></div><div class=x2>{body}</div></body>", "h"))
    rows += [(40, None, None, "h"), (41, "https://hot.example.com/e", "", "h"), (42, "https://one.example.com", "<div class=x1><p>Same words on every page</p></div>", "h")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in extract(df).collect()}
    assert len(got) == 43
    for i, url, page, _ in rows:
        want = "Same words on every page" if i == 42 else "\n".join(x.split("</p>")[0] for x in (page or "").split("<p>")[2:])
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == url
    scores = importance(style_features(df.select("url", "html"))).where("host = 'hot.example.com'").collect()
    assert min(r.importance for r in scores) < 0.3 < max(r.importance for r in scores)
    assert extract(df.limit(0)).collect() == []


def test_planted_articles(spark):
    """Pages as the tables have them, with a known article."""
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(120):
        paras = [" ".join(rng.choice(["a", "<b>", "&", "tré", "x;"]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        want[i] = "\n".join(" ".join(p.split()) for p in paras)
        inner = "".join(f"<p>{html.escape(p)}</p>" for p in paras[1:])
        rows.append((i, "http://a.example.com/" + str(i), f"<html><body><nav>m{i}</nav><div class='ad'>ad{i}</div><article><h1>{html.escape(paras[0])}</h1>{inner}</article><footer>f{i}</footer>"))
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_host_of_is_the_sql_one(spark):
    from pyspark.sql import functions as F

    urls = ["https://u:p@A.example.com:80/x?y#z", "http://b.org", "c.org/x", "", None, "https://d.example.com?q=1@x", "//e.org/x"]
    pattern = r"^(?:[^/?#]*?://)?(?:[^/?#]*@)?([^/?#:]*)"
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), pattern, 1)).alias("h"))
    assert [r.h for r in df.collect()] == [host_of(u) for u in urls]


def test_hostile_pages_take_time_in_proportion():
    import time

    began = time.time()
    assert main_text("<p>a</p>" + "İ" * 60 + "<script>x</script>more") == "a\n" + "İ" * 60 + "more"
    pages = ['<a "' * 250_000, "<div>" * 50_000 + "</p>" * 50_000, "<b>" * 50_000 + "x<hr>" * 25_000, "<!" * 300_000, "<a x='" * 100_000, '<p a="' * 100_000 + ">", "<b>" * 30_000 + "<div></div>" * 30_000, "</x>" * 100_000]
    for page in pages:
        main_text(page)
    assert time.time() - began < 30


def test_tree_judges_inside_articles_and_counts_copies_once(spark):
    """A notice that a host repeats in its articles goes by its importance alone; copies of one page don't make its text a template."""
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(40):
        own = " ".join(str(rng.random()) for _ in range(6))
        rows.append((i, f"http://t.example.com/{i}", f"<article><h1>Title {i}</h1><div class=zz>Written by our staff.</div><p>{own}</p></article>"))
        want[i] = f"Title {i}\n{own}"
    for i in range(40, 60):
        rows.append((i, f"http://m.example.com/{i}", "<article><h1>One page</h1><p>The only text of a mirror.</p></article>"))
        want[i] = "One page\nThe only text of a mirror."
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == want
    judged = importance(style_features(df)).where("host = 't.example.com'").collect()
    assert len(judged) == 3 and all(r.main for r in judged) and min(r.importance for r in judged) < 0.1 < sorted(r.importance for r in judged)[1]
