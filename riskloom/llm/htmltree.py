"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: a node of it is the path of tags and classes from the root. For each node two
kinds of evidence are counted over the host's different pages (copies count once), by grouped aggregation: its presentation (the styles, that is the
sequences of child tags, it shows) and its content (the texts it holds). With m pages that have the node, a style on
a share p of them adds -p log_m p to the presentation's entropy, and a text on c of them has the entropy log_m c: what
varies from page to page matters, what a site repeats does not. The composite importance weighs both. Every node that holds text is judged, in
articles and outside. The text of nodes of low importance is taken out of each page (inside articles they must be nearly the same on all pages), and with it what tag,
role or class declare as something else; of the rest, the articles are the main text, or all of it where a page marks none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, raw_strings, written

# How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element of the key's kind ends an open one of these kinds, up to the nearest element of the third set.
_SCOPE = frozenset("article aside blockquote body button center dd details div dl fieldset figure footer form header html li main nav ol section table td th tr ul".split())
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Tags, roles and class words of what is no main text.
OUT_TAGS = RAW | frozenset("aside button canvas datalist dialog footer form head input label menu nav object select svg".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts advertorial alert banner banners breadcrumb breadcrumbs byline-share captcha "
    "comment commentlist comments consent cookie cookies copyright disclaimer discussion disqus footer footers form gdpr header headers hidden login "
    "masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos "
    "promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
MAIN_TAGS = frozenset(["article", "main"])

#: Comments, declarations, and tags (end mark, name, attributes, whether they end before the page does): each match takes time in proportion to its length.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:(>)|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
END_OF = {tag: re.compile(f"</{tag}", re.ASCII | re.IGNORECASE) for tag in RAW}

#: Of content in the composite importance, against presentation; what counts as low; pages a host's node must be on to be judged.
CONTENT_WEIGHT, LOW, LEAST_PAGES = 0.9, 0.3, 5
#: What counts as low inside articles.
LOW_IN_ARTICLE = 0.1
#: Low nodes of all hosts that are broadcast, at most 16 MB; beyond that pages are shuffled by host and one of SALTS numbers.
MAX_BROADCAST_NODES, SALTS = 1_000_000, 64


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), entities.unescape((m[2] or "").strip("\"'")))
    return out


def declared_out(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """Whether an element's tag, role, class or style says that it is no main text. A header inside an article stays."""
    if tag in MAIN_TAGS and "comment" not in (a.get("class", "") + a.get("id", "")).lower():
        return False
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return True
    if not a:
        return False
    if a.get("role", "").lower() in OUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.IGNORECASE):
        return True
    if tag in ("html", "body"):
        return False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    if in_article and tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "header"):
        names = [n for n in names if "header" not in n]
    return any(n in OUT_WORDS or not OUT_WORDS.isdisjoint(re.split(r"[-_\d]+", n)) for n in names)


def number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class Node:
    """An open element; block is the innermost block around it, itself included."""

    __slots__ = ("tag", "path", "out", "main", "in_article", "children", "block")

    def __init__(self, tag: str, path: int, out: bool, main: int, in_article: bool, block: Node | None = None):
        self.tag, self.path, self.out, self.main, self.in_article, self.children = tag, path, out, main, in_article, []
        self.block = self if block is None or tag in BLOCK else block


def walk(page: str, low: frozenset[int] = frozenset(), nodes: list[tuple[int, int]] | None = None) -> list[tuple[int, bool, int, str]]:
    """The blocks of a page in order: path, whether it is out, what marks it as main (0: nothing, 1: main, 2: article), text.

    low: paths whose own text is out. nodes, if given, gets (path, style) of each element. The time grows with the page's length.
    """
    out: list[tuple[int, bool, int, str]] = []
    root = Node("", 0, False, 0, False)
    stack: list[Node] = [root]
    open_tags: Counter[str] = Counter()
    run: list[str] = []  # the text of the open block
    holder: list[Node] = []  # the elements where it began: the block, the innermost

    def add(text: str) -> None:
        if stack[-1].out and stack[-1].tag not in BLOCK:
            return  # inside an inline element that is out
        if not run:
            holder[:] = [stack[-1].block, stack[-1]]
        run.append(text)

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                out.append((holder[0].path, holder[1].out or holder[0].path in low, holder[1].main, text))
            run.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack[-1]
            if node.tag in BLOCK:
                flush()
            if nodes is not None:
                nodes.append((node.path, number(" ".join(node.children))))
            stack.pop()
            open_tags[node.tag] -= 1

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if not m:
            break
        if m[2] is not None and m[4] is None and page.find(">", m.start()) < 0:
            break  # no tag ends any more: what is left is text
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if open_tags[tag]:
                pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag == "p":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag == "br":
            add(" ")
            continue
        a = attributes(m[3]) if m[3].strip(" /\n\t\r") else {}
        if tag in BLOCK:
            if open_tags["p"]:
                for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                    if stack[i].tag == "p":
                        pop_to(i)
                        break
                    if stack[i].tag in _SCOPE:
                        break
            flush()
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            if any(open_tags[x] for x in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        pop_to(i)
                        break
                    if stack[i].tag in within:
                        break
        top = stack[-1]
        label = tag + "".join(sorted(f".{c.lower()}" for c in a.get("class", "").split()))
        top.children.append(label)
        path = number(f"{top.path}>{label}")
        is_out = top.out or declared_out(tag, a, top.in_article)
        main = max(top.main, 2 if tag == "article" or a.get("itemprop", "").lower() == "articlebody" else 1 if tag == "main" or a.get("role", "").lower() == "main" else 0)
        if tag in RAW:  # its content is no markup
            end = END_OF[tag].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = len(page) if close < 0 else close + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        stack.append(Node(tag, path, is_out, main, top.in_article or main == 2, top.block))
        open_tags[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    pop_to(1)
    return out


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The main text: the kept blocks of the articles (else of main, else all), joined by newlines."""
    kept = [(main, text) for _, out, main, text in walk(page, low) if not out]
    best = max((main for main, _ in kept), default=0)
    return "\n".join(text for main, text in kept if main >= best)


def host_of(url: str) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def style_features(pages: DataFrame) -> DataFrame:
    """(host, path, main, kind, feature, page) once for each page: kind 0 a style of the node, 1 a text in it; page is a hash of the page's markup. Every node that holds text votes, in articles and
    outside; what tag, role or class declare as something else is out anyway."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("main", pa.bool_()), ("kind", pa.int8()), ("feature", pa.int64()), ("page", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = raw_strings(batch.column("html"))
            for lo, hi in blocks(offsets, 4 << 20):
                b = batch.slice(lo, hi - lo)
                columns: tuple[list, ...] = ([], [], [], [], [], [])
                for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                    nodes: list[tuple[int, int]] = []
                    found = [x for x in walk(page or "", nodes=nodes) if not x[1]]
                    inside = {p: main == 2 for p, _, main, _ in found}
                    rows = {(p, inside[p], 1, number(t)) for p, _, _, t in found} | {(p, inside[p], 0, s) for p, s in nodes if p in inside}
                    columns[0].extend([host_of(url)] * len(rows))
                    columns[5].extend([number(page or "")] * len(rows))
                    for c, values in zip(columns[1:5], zip(*rows)):
                        c.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return pages.mapInArrow(run, "host string, path bigint, main boolean, kind tinyint, feature bigint, page bigint")


def importance(features: DataFrame) -> DataFrame:
    """(host, path, main, pages, importance) of each node of each host's style tree; main: it is in an article. A hot host's rows are counted before they are shuffled."""
    key = ["host", "path", "main", "kind", "feature"]
    counts = features.groupBy(*key, "page").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("c"))
    # With m = the node's styles over its pages: sum of c; entropies follow from sums of c ln c alone.
    sums = counts.groupBy("host", "path", "main", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
    both = sums.groupBy("host", "path", "main").agg(
        F.max(F.when(F.col("kind") == 0, F.col("m"))).alias("pages"),
        F.max(F.when(F.col("kind") == 0, F.col("s"))).alias("style_s"),
        F.max(F.when(F.col("kind") == 1, F.col("m"))).alias("texts"),
        F.max(F.when(F.col("kind") == 1, F.col("s"))).alias("text_s"),
    )
    style = F.when(F.col("pages") > 1, (F.log("pages") - F.col("style_s") / F.col("pages")) / F.log("pages")).otherwise(F.lit(1.0))
    content = F.when(F.col("pages") > 1, F.lit(1.0) - F.col("text_s") / F.col("texts") / F.log("pages")).otherwise(F.lit(1.0))
    both = both.where("pages is not null and texts is not null")
    return both.select("host", "path", "main", "pages", (F.lit(1 - CONTENT_WEIGHT) * style + F.lit(CONTENT_WEIGHT) * content).alias("importance"))


def extract(pages: DataFrame, low: float = LOW, least_pages: int = LEAST_PAGES, low_in_article: float = LOW_IN_ARTICLE) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html; more columns are ignored).

    Null or empty html, and a page without main text, give an empty text; a null url is a host of its own. Rows that repeat
    are extracted each, and count as one page of their host. Tags that the page's end cuts off are dropped, unless no > follows them at all: then they are text. Whole pages are read, however long,
    in time that grows with their length. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    judged = importance(style_features(rows.select("url", "html"))).where((F.col("pages") >= least_pages) & (F.col("importance") < F.when(F.col("main"), low_in_article).otherwise(low)))
    taken = written(judged.groupBy("host").agg(F.collect_set("path").alias("low")), "low-nodes")  # a few nodes of each host's template
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[^/?#]*?://)?(?:[^/?#]*@)?([^/?#:]*)", 1))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = raw_strings(batch.column("html"))
            for lo, hi in blocks(offsets, 4 << 20):
                b = batch.slice(lo, hi - lo)
                texts = [main_text(page or "", frozenset(paths or ())) for page, paths in zip(b.column("html").to_pylist(), b.column("low").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = rows.withColumn("host", host)
    if taken.agg(F.coalesce(F.sum(F.size("low") + 4), F.lit(0))).first()[0] <= MAX_BROADCAST_NODES:
        joined = rows.join(F.broadcast(taken), "host", "left")
    else:  # a hot host's pages go to SALTS tasks
        salted = taken.select("host", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "low")
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
