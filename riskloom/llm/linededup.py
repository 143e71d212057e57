"""Line dedup by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its words (runs of non-blanks in lower case). Lines with equal sets are one class, led by its first
line; leaders are joined on Jaccard >= 4/5, so two of a and c words differ in at most (a + c) / 9 words.

Words are ordered by rarity: all words fall into 16384 hash buckets, which are ranked by their counts over all lines, and
within a bucket the hash decides. In a corpus of any size every single word is in very many lines, so lists of words would grow with
its square; the prefix filter therefore lists a line under pairs of words that are neighbours in this order. Between two words that
both of n and m words have there is no other one unless a differing word lies there, so the first shared pair of neighbours comes after at most 2 x + y words of
a line, if x of its words and y of the other's differ: that is (2 n - m) / 3, and 2 n / 5 at most, as m is 4 n / 5 at least. Those are the
prefix.

Lines under one key are first compared with the first of them; only lines that this doesn't settle are then compared
with the others before them, if sizes and a parity sketch let them pass. What passes is verified on the whole sets. A line
goes if an earlier one, in order of doc_id and place, matches it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Lines whose places are broadcast at most (16 bytes each); beyond that Spark joins by a shuffle.
MAX_BROADCAST_SETTLED = 1_000_000
#: Listed lines are dealt by their keys, and pairs by their later lines, in so many parts, one after the other, so that a part's shuffle files are gone before the next one's come.
PARTS = 4
#: Words are counted in 2 ** BUCKET_BITS buckets of their hashes.
BUCKET_BITS = 14
#: A listed line's meta: bits of the sketch, of the size, of the place; the largest size and place stand for all beyond and pass the filters. The sketch has another 64 bits in a column of its own, as 44 are full at some fifty words.
_SKETCH, _SIZE, _PLACE = 44, 11, 9
_MOST_SIZE, _MOST_PLACE = (1 << _SIZE) - 1, (1 << _PLACE) - 1
_NO_ID = -(1 << 63)
_BLANKS = " \t\n\x0b\x0c\r"


def words_of(line: Column) -> Column:
    """The words, as often as they come, and maybe empty strings between them."""
    other = reduce(lambda a, b: a | b, (F.contains(line, F.lit(c)) for c in _BLANKS if c not in " \n"))
    return F.split(F.lower(F.when(other, F.translate(line, _BLANKS[1:], " " * 5)).otherwise(line)), " ")


def word_hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(F.array_remove(words_of(line), ""), lambda w: F.xxhash64(w)))


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) == ""


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc (doc_id; nulls have a number of their own), base and text: the lines of a doc's rows count on from base, so (doc, base) is a key.
    Also, whether every doc is one row, so that base is 0."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"_{c}") for c in docs.columns if c != "text"))
    if not rows.groupBy("doc").count().where("count > 1").limit(1).collect():
        return rows.withColumn("base", F.lit(0)), True
    before = Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1)
    return written(rows.withColumn("base", F.coalesce(F.sum(F.size(F.split("text", "\n", -1))).over(before), F.lit(0)).cast("int")), "lines-numbered"), False


def lines_of(rows: DataFrame) -> DataFrame:
    """doc, ln, base, line of the lines that have words."""
    lines = rows.select("doc", "base", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc", (F.col("base") + F.col("pos")).alias("ln"), "base", "line").where(~is_blank(F.col("line")))


def rarity(rows: DataFrame) -> list[int]:
    """The rank of each bucket of words, the rarest first, from the counts of all words of all texts."""
    bucket = F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS).cast("int").alias("bucket")
    words = rows.select(F.explode(F.split(F.lower(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))), " ")).alias("w"))  # rarer blanks don't matter here
    counts = dict(map(tuple, words.groupBy(bucket).count().collect()))  # a row for each bucket
    order = sorted(range(1 << BUCKET_BITS), key=lambda b: (counts.get(b, 0), b))
    rank = [0] * len(order)
    for r, b in enumerate(order):
        rank[b] = r
    return rank


def coded(line: Column, rank: list[int]) -> Column:
    """The words of a line as numbers in order of rarity: a bucket's rank takes the bucket's bits of the hash."""
    # moved[b] turns the upper bits of a hash in bucket b into those of its rank.
    half = 1 << (BUCKET_BITS - 1)
    moved = [((b ^ r ^ half) << (64 - BUCKET_BITS)) for b, r in enumerate(rank)]
    table = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in moved)), ",").cast("array<bigint>")
    return F.sort_array(F.transform(word_hashes(line), lambda h: h.bitwiseXOR(F.get(table, F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")))))


def listed(lines: DataFrame, rank: list[int]) -> DataFrame:
    """lines (doc, ln, base, line) with c1 and c2 (hashes of the set), keys (of the pairs of neighbours in the prefix), meta and more (a sketch over both with a bit for each odd number of words that fall on it; meta has the size too)."""
    t = lines.select("doc", "ln", "base", coded(F.col("line"), rank).alias("s"))
    length = F.when(F.size("s") >= 4, F.floor(F.size("s") * 2 / 5).cast("int") + 1).otherwise(0)  # smaller sets match equal ones alone
    t = t.select("*", length.alias("prefix"))
    keys = F.zip_with(F.slice("s", F.lit(1), F.col("prefix")), F.slice("s", F.lit(2), F.col("prefix")), lambda a, b: F.shiftrightunsigned(F.xxhash64(a, b), 16))  # 48 bits: a list that two pairs share costs time alone
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    shifted = lambda unit, bits: F.call_function("shiftleft", unit, bits.cast("int"))
    # A word is on one side or the other, by its lowest bit.
    more = F.aggregate("s", zero, lambda acc, x: acc.bitwiseXOR(shifted(x.bitwiseAND(one), F.shiftright(x, 1).bitwiseAND(F.lit(63).cast("bigint")))))
    sketch = F.aggregate("s", zero, lambda acc, x: acc.bitwiseXOR(shifted(x.bitwiseAND(one).bitwiseXOR(one), F.shiftrightunsigned(x, 7) % _SKETCH)))
    meta = F.shiftleft(sketch, _SIZE + _PLACE).bitwiseOR(F.shiftleft(F.least(F.size("s"), F.lit(_MOST_SIZE)).cast("bigint"), _PLACE))
    return t.select("doc", "ln", "base", F.xxhash64("s").alias("c1"), F.xxhash64(F.lit(1), "s").alias("c2"), keys.alias("keys"), meta.alias("meta"), more.alias("more"))


def leaders(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, ln, base, keys, meta and more of the first line of each set of words."""
    rows = listed(lines, rarity(rows)).select("c1", "c2", F.struct("doc", "ln", "base").alias("at"), "keys", "meta", "more")
    return rows.groupBy("c1", "c2").agg(F.min("at").alias("at"), *(F.first(c).alias(c) for c in ("keys", "meta", "more"))).select("at.*", "keys", "meta", "more")


def may_match(one: str, two: str) -> Column:
    """The filters on meta and more of two aliases (or structs), with the key's place: length, place, and that the sketches have no more odd bits than words may differ."""
    a, b = F.col(f"{one}meta"), F.col(f"{two}meta")
    size = lambda m: F.shiftrightunsigned(m, _PLACE).bitwiseAND(F.lit(_MOST_SIZE))
    place = lambda m: m.bitwiseAND(F.lit(_MOST_PLACE))
    na, nb, pa, pb = size(a), size(b), place(a), place(b)
    length = 5 * F.least(na, nb) >= 4 * F.greatest(na, nb)
    most = F.least(pa, pb) + F.least(na - pa, nb - pb)  # words in common, at most
    bits = 9 * (F.bit_count(F.shiftrightunsigned(a.bitwiseXOR(b), _SIZE + _PLACE)) + F.bit_count(F.col(f"{one}more").bitwiseXOR(F.col(f"{two}more")))) <= na + nb
    beyond = (na == _MOST_SIZE) | (nb == _MOST_SIZE) | (pa == _MOST_PLACE) | (pb == _MOST_PLACE)
    return beyond | (length & bits & (9 * most >= 4 * (na + nb)))


def matched(pairs: DataFrame, rows: DataFrame, broadcast: int) -> DataFrame:
    """(doc, ln) of the later lines of pairs (d1, l1, d2, l2) whose whole sets match; only texts of rows that hold such lines are cut."""
    pairs = written(pairs.distinct(), "line-pairs")
    asked = written(pairs.select(F.col("d1").alias("doc"), F.col("l1").alias("ln")).unionByName(pairs.select(F.col("d2").alias("doc"), F.col("l2").alias("ln"))).distinct(), "lines-asked")
    few = asked.count() <= broadcast
    docs = asked.select("doc").distinct()
    lines = lines_of(rows.join(F.broadcast(docs) if few else docs, "doc", "left_semi"))
    sets = lines.join(F.broadcast(asked) if few else asked, ["doc", "ln"], "left_semi").select("doc", "ln", word_hashes(F.col("line")).alias("h"))
    sets = written(sets, "lines-sets")
    a, b = (sets.select(F.col("doc").alias(f"d{i}"), F.col("ln").alias(f"l{i}"), F.col("h").alias(f"h{i}")) for i in (1, 2))
    enough = 9 * F.size(F.array_intersect("h1", "h2")) >= 4 * (F.size("h1") + F.size("h2"))
    out = []
    for i in range(PARTS):  # a pair takes the sets of both lines along
        both = pairs.where(F.pmod(F.xxhash64("d2", "l2"), F.lit(PARTS)) == i).join(a, ["d1", "l1"]).join(b, ["d2", "l2"])
        out.append(written(both.where(enough).select(F.col("d2").alias("doc"), F.col("l2").alias("ln")).distinct(), "lines-matched"))
    dropped(pairs, asked, sets)
    return reduce(DataFrame.unionByName, out)  # each line is in one part


def repeats(first: DataFrame, texts: DataFrame, broadcast: int = MAX_BROADCAST_SETTLED, parts: int = PARTS) -> DataFrame:
    """(doc, ln) of the leaders (of the rows texts) that an earlier leader matches. The keys are taken in so many parts, one after the other."""
    rows = first.select(F.posexplode("keys").alias("place", "key"), "doc", "ln", "meta", "more")
    rows = rows.select("key", "doc", "ln", "more", F.col("meta").bitwiseOR(F.least("place", F.lit(_MOST_PLACE)).cast("bigint")).alias("meta"))
    head = F.first(F.struct("doc", "ln", "meta", "more")).over(Window.partitionBy("key").orderBy("doc", "ln"))
    shared, pairs = [], []

    # Each line against the first of its key.
    for i in range(parts):
        t = rows.where(F.col("key") % parts == i).withColumn("times", F.count("*").over(Window.partitionBy("key"))).where("times > 1")
        shared.append(written(t.select("key", "doc", "ln", "meta", "more", "times", head.alias("head")), "lines-shared"))
        near = shared[-1].where(((F.col("head.doc") != F.col("doc")) | (F.col("head.ln") != F.col("ln"))) & may_match("head.", ""))
        pairs.append(written(near.select(F.col("head.doc").alias("d1"), F.col("head.ln").alias("l1"), F.col("doc").alias("d2"), F.col("ln").alias("l2")).distinct(), "lines-near"))
    found = matched(reduce(DataFrame.unionByName, pairs), texts, broadcast)
    dropped(*pairs)

    # What that doesn't settle, against all others before it: two lines alone under a key have been compared.
    settled, pairs = F.broadcast(found) if found.count() <= broadcast else found, []
    earlier = (F.col("a.doc") < F.col("b.doc")) | ((F.col("a.doc") == F.col("b.doc")) & (F.col("a.ln") < F.col("b.ln")))
    for part in shared:
        t = part.where("times > 2").select("key", "doc", "ln", "meta", "more")
        a, b = t.alias("a"), t.join(settled, ["doc", "ln"], "left_anti").alias("b")
        both = a.join(b, (F.col("a.key") == F.col("b.key")) & earlier & may_match("a.", "b."))
        both = both.select(F.col("a.doc").alias("d1"), F.col("a.ln").alias("l1"), F.col("b.doc").alias("d2"), F.col("b.ln").alias("l2"))
        pairs.append(written(both.distinct(), "lines-near"))
        dropped(part)
    out = found.unionByName(matched(reduce(DataFrame.unionByName, pairs), texts, broadcast)).distinct()
    dropped(*pairs)
    return out


def deduplicated(docs: DataFrame, broadcast: int = MAX_BROADCAST_SETTLED) -> DataFrame:
    """docs (doc_id, text; other columns stay as they are, but for n_lines and n_removed) with text rid of lines that an earlier line matches, and n_lines, n_removed.

    Lines end at \\n. A line without words stays. Of lines that match, the first stays, by doc_id (null ids first), then place;
    rows with one doc_id follow each other in order of their texts' hashes, so of repeated rows one keeps its lines. A line goes even where the
    earlier line that it matches goes too. Null text counts as empty. A text may end up empty; its row stays. Lines are read whole, however
    long. An empty table gives no rows.
    """
    rows, _ = numbered(docs)
    first = written(leaders(rows, lines_of(rows)), "lines-first")
    gone = repeats(first, rows, broadcast)
    gone = F.broadcast(gone) if gone.count() <= broadcast else gone
    kept = first.select("doc", "ln", "base").join(gone, ["doc", "ln"], "left_anti")
    kept = written(kept.groupBy("doc", "base").agg(F.collect_list(F.col("ln") - F.col("base")).alias("stay")), "lines-kept")
    dropped(first)
    out = rows.join(kept, ["doc", "base"], "left").select("*", F.split("text", "\n", -1).alias("line"))
    count = F.size("line")
    blank = F.filter(F.sequence(F.lit(0), count - 1), lambda i: is_blank(F.get("line", i)))
    out = out.select("*", F.sort_array(F.concat(blank, F.coalesce("stay", F.array().cast("array<int>")))).alias("places"))
    text = F.array_join(F.transform("places", lambda i: F.get("line", i)), "\n")
    columns = [text.alias(c) if c == "text" else F.col(f"_{c}").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, count.alias("n_lines"), (count - F.size("places")).alias("n_removed"))
