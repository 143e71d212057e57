"""N-gram Jaccard join by PartEnum signatures.

Sets of shingles (4 words, unless told otherwise) link when 100 |A n B| >= percent |A u B| (85, so here). Sizes are cut into bands; within a band whose largest size is
r, linked sets differ in at most k = floor(30 r / 185) elements. The domain is dealt by a hash into n1 = floor(k / 2) + 1 + c
partitions of three parts each. In c + 1 of the partitions at most one element differs, so that linked sets agree on two of
the three parts: every subset of two parts is enumerated, and a signature (band, partition, subset, content) is shared. The spare
c pays for leaving out the subsets that say little: a set skips contents of under m elements for the largest m with
at most c partitions that have one; of the c + 1 on which two linked sets agree, one has enough elements for both. A set near the top
of its band also has signatures in the next one.

Sets that are equal are one class, with one row per signature. Candidates within a signature are not all paired: in each round every
class is checked against one hub (the member of another component with which it shares most signatures), and components
follow. Rounds go on as long as they find links; then only pairs whose components still differ are paired, behind the length filter and a parity sketch whose differing bits never
exceed the differing elements. The sketch fills up with sets beyond its bits, so these have a wide one besides, of as many bits as elements, which the pairs that
are left must pass before their texts are fetched. All checks count whole sets exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, mask_hashes, mix, raw_strings, spread, words, written
from .graph import components

SHINGLE, PERCENT, BAND_GROWTH, SPARE, MOST_LEFT_OUT, SKETCH_BITS = 4, 85, 1.5, 0.1, 4, 1024
#: Parts of a partition; the subsets of all but one of them are enumerated. Bits of a signature: sets that share one by chance are told apart when they are verified.
PARTS, SIGNATURE_BITS = 3, 48
#: Signatures are dealt in so many parts, one after the other, each enumerated anew: a part's shuffle files are gone before the next one's come.
DEALS = 2
#: Rounds of hubs at most, before the pairs that are left; pairs of a hub that are verified together.
MOST_ROUNDS, HUB_PAIRS = 8, 500
#: Ids of 8 bytes: at most 16 MB are broadcast; beyond that the texts are shuffled.
MAX_BROADCAST_IDS = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each different shingle, sorted; with fewer words, the whole sequence is one shingle."""
    _, _, h, first = words(data, offsets)
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    owner = [np.repeat(np.arange(len(counts)), full)]
    every = mask_hashes(h, tuple(range(size)))
    found = [every[spread(first[:-1], full)]] if len(every) else [np.zeros(0, np.uint64)]
    if not len(every):
        owner = [np.zeros(0, np.int64)]
    for k in range(1, size):
        at = np.flatnonzero(counts == k)
        if len(at):
            few = np.full(len(at), k, np.uint64)
            for i in range(k):
                few = mix(few * np.uint64(31) + h[first[at] + i])
            owner.append(at)
            found.append(few)
    doc, key = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    if len(doc) > 1:
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[new], key[new]


def bands(most: int) -> np.ndarray:
    """The least size of each band, up to two beyond most."""
    out = [1]
    while len(out) < 3 or out[-3] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_GROWTH)))
    return np.array(out)


def most_different(total: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The most elements in which linked sets of so many elements together can differ."""
    return (100 - percent) * total // (100 + percent)


def signatures(doc: np.ndarray, key: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) of sets given as (doc, key), with n elements each."""
    edges = bands(int(n.max(initial=0)))
    own = np.searchsorted(edges, n, side="right") - 1
    up = (n > 0) & (100 * n >= percent * edges[np.maximum(own, 0) + 1])
    who = np.concatenate([np.flatnonzero(n > 0), np.flatnonzero(up)])
    band = np.concatenate([own[n > 0], own[up] + 1])
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = most_different(2 * (edges[band + 1] - 1), percent)
    spare = np.ceil(SPARE * (k // 2 + 1)).astype(np.int64) * (k > 4)
    count = k // 2 + 1 + spare  # partitions
    base = np.cumsum(count) - count
    first = np.searchsorted(doc, who)
    at = spread(first, n[who])
    unit = np.repeat(np.arange(len(who)), n[who])
    element = key[at]
    part = (mix(element ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24)).astype(np.int64) % (PARTS * count)[unit]
    slot, total = PARTS * base[unit] + part, PARTS * int(count.sum())
    value = mix(element ^ np.uint64(0x14057B7EF767814F))
    sums = lambda w: np.bincount(slot, weights=w, minlength=total).reshape(-1, PARTS)
    unit = np.repeat(np.arange(len(who)), count)
    left_out = (k[unit] > 0).astype(np.uint64)[:, None]  # where nothing may differ, the one subset is the whole set
    # Of each subset, what all parts but one hold; sums of 32 bits are exact under 2**53.
    parts = (sums(None).astype(np.uint64), *(sums((value >> s & np.uint64(0xFFFFFFFF)).astype(np.float64)).astype(np.uint64) for s in (np.uint64(0), np.uint64(32))))
    size, low, high = (x.sum(axis=1, keepdims=True) - left_out * x for x in parts)
    poorest = size.min(axis=1)
    least = np.zeros(len(who), np.int64)
    for m in range(1, MOST_LEFT_OUT + 1):
        least[np.add.reduceat((poorest < m).astype(np.int64), base) <= spare] = m
    number = (PARTS * (np.arange(len(unit)) - base[unit]))[:, None] + np.arange(PARTS)
    sig = mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high + (band[unit][:, None] * 1_000_003 + number).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) + size)
    row, subset = np.nonzero((size >= least[unit][:, None].astype(np.uint64)) & ((left_out > 0) | (np.arange(PARTS) == 0)))
    return who[unit[row]], sig[row, subset]


def class_names(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A name for each set, given the sets' elements one after the other and their sizes; 0 for empty ones."""
    out, has = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(has):
        starts = (np.cumsum(n) - n)[has]
        total, odd = np.add.reduceat(mix(key), starts), np.bitwise_xor.reduceat(mix(key ^ np.uint64(0xD1342543DE82EF95)), starts)
        out[has] = mix(total + mix(odd + n[has].astype(np.uint64)))
    return out


def wide_sketches(doc: np.ndarray, bit: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """A parity sketch of 2**j >= n bits for each set of more than SKETCH_BITS elements (others: empty), given each element's random number."""
    big = np.flatnonzero(n > SKETCH_BITS)
    bits = np.zeros(len(n), np.int64)
    bits[big] = 1 << np.ceil(np.log2(n[big])).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(bits)])
    some = bits[doc] > 0
    doc, bit = doc[some], bit[some]
    odd = (np.bincount(ends[doc] + bit % bits[doc], minlength=ends[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(ends // 64, pa.int32()), pa.array(np.packbits(odd).view(np.int64)))


def described(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, hash (of the text), n, class, sketch and wide (sketch) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64()))])
    step = SKETCH_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                doc, key = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                rows = hi - lo
                n = np.bincount(doc, minlength=rows)
                bit = (mix(key ^ np.uint64(0xA24BAED4963EE407)) >> np.uint64(20)).astype(np.int64)
                odd_bits = (np.bincount(doc * SKETCH_BITS + bit % SKETCH_BITS, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
                sketch = np.packbits(odd_bits.reshape(rows, SKETCH_BITS), axis=1).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * step, pa.int32()), pa.array(sketch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, rows), batch.column("hash").slice(lo, rows), pa.array(n, pa.int64()), pa.array(class_names(key, n).view(np.int64)), lists, wide_sketches(doc, bit, n)], schema=schema)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(run, "doc_id bigint, hash bigint, n bigint, class bigint, sketch array<bigint>, wide array<bigint>")


def signed(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, part: int = 0, parts: int = 1) -> DataFrame:
    """class and sigs (its signatures, of SIGNATURE_BITS, that fall on part) once for each class that a task meets. They are enumerated anew from the texts, as they take far more room than the sets' names."""
    schema = pa.schema([("class", pa.int64()), ("sigs", pa.list_(pa.int64()))])
    low = np.uint64((1 << SIGNATURE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                doc, key = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                rows = hi - lo
                n = np.bincount(doc, minlength=rows)
                name = class_names(key, n)
                fresh = np.zeros(rows, bool)
                for i in np.flatnonzero(n).tolist():
                    x = int(name[i])
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                some = fresh[doc]
                who, sig = signatures(doc[some], key[some], np.where(fresh, n, 0), percent)
                mine = (sig & low) % np.uint64(parts) == np.uint64(part)
                who, sig = who[mine], sig[mine]
                order = np.argsort(who, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=rows))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((sig[order] & low).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), lists], schema=schema).filter(pa.array(fresh))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "class bigint, sigs array<bigint>")


def place_of(doc_id: Column, text_hash: Column) -> Column:
    """What finds a text: rows may share an id, or have none, and hold other texts."""
    return F.struct(doc_id.isNull().alias("void"), F.coalesce(doc_id, F.lit(0)).alias("id"), text_hash.alias("hash"))


def may_link(a: str, b: str, percent: int = PERCENT):
    """The length filter and the parity sketch's bound, for columns n and sketch of two aliases."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (bits * (100 + percent) <= (na + nb) * (100 - percent))


def may_link_wide(a: str, b: str, percent: int = PERCENT):
    """The wide sketches' bound, for columns n and wide of two aliases; the longer sketch is folded, and where one is missing (or the other too long) the pair passes."""
    wa, wb = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    na, nb = F.size(wa), F.size(wb)
    folded = lambda w, n: F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, n + 1, n), lambda x, y: x.bitwiseXOR(y))
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, x: acc + x)
    odd = F.when((na == 0) | (nb == 0), 0).when(na == nb, bits(wa, wb)).when(na == 2 * nb, bits(folded(wa, nb), wb)).when(nb == 2 * na, bits(wa, folded(wb, na))).otherwise(0)
    return odd * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def verified(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b, doc_a, doc_b: places of texts of the classes a and b) whose sets link, counted from the whole texts."""
    pairs = written(pairs, "pairs")
    made = ids = written(pairs.select(F.col("doc_a").alias("id")).unionByName(pairs.select(F.col("doc_b").alias("id"))).distinct(), "pair-ids")
    if ids.count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    text = F.col("text").cast("string")
    texts = docs.select(place_of(F.col("doc_id").cast("bigint"), F.xxhash64(text)).alias("id"), text.alias("text")).join(ids, "id", "left_semi").dropDuplicates(["id"])
    texts = written(texts, "pair-texts")
    # A hub stands in many pairs: its text goes to as many tasks as its pairs need.
    parts = pairs.groupBy("doc_b").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(texts.select(F.col("id").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(parts, "doc_b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    hubs = texts.withColumnRenamed("id", "doc_b").join(parts, "doc_b").select("doc_b", F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(hubs, ["doc_b", "part"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = raw_strings(batch.column("text_a"))
            for lo, hi in blocks(offsets):
                part = batch.slice(lo, hi - lo)
                sets = [shingle_sets(*raw_strings(part.column(c)), size) for c in ("text_a", "text_b")]
                doc, key = (np.concatenate(x) for x in zip(*sets))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                same = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) if len(doc) > 1 else np.zeros(0, bool)
                common = np.bincount(doc[1:][same], minlength=hi - lo)
                union = np.bincount(doc, minlength=hi - lo) - common
                take = pa.array(np.flatnonzero((100 * common >= percent * union) & (union > 0)))
                yield pa.RecordBatch.from_arrays([part.column("a").take(take), part.column("b").take(take)], schema=schema)

    links = written(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "links")
    dropped(pairs, made, texts)
    return links


def small(table: DataFrame, rows: int) -> DataFrame:
    """table, of at most so many rows of two numbers, to be broadcast if that is 16 MB at most; beyond it Spark shuffles."""
    return F.broadcast(table) if rows <= MAX_BROADCAST_IDS else table


def unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, class, label of the signatures of rows (sig, class) whose classes are in several components. labels: node, label, written. The rows are dealt once."""
    rows = rows.select("sig", "class").join(small(labels.withColumnRenamed("node", "class"), labels.count()), "class", "left").withColumn("label", F.coalesce("label", "class")).repartition("sig")
    several = rows.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig")
    return rows.join(several.hint("shuffle_hash"), "sig")


def hub_pairs(rows: DataFrame, turn: int, classes: int) -> DataFrame:
    """(a, b) of each class a of rows (sig, class, label) and the hub of another component with which it shares most signatures. classes: how many there are at most.

    The hub of a signature is its heaviest class in the first turn, then the heaviest of a component that the turn's hash picks.
    """
    weight = rows.groupBy("class").agg(F.count("*").alias("weight"))
    pick = F.lit(0) if not turn else F.xxhash64("label", F.lit(turn))
    dealt = rows.join(small(weight, classes), "class").repartition("sig")
    hubs = dealt.groupBy("sig").agg(F.max(F.struct(pick.alias("pick"), "weight", "class", "label")).alias("hub")).select("sig", F.col("hub.class").alias("hub"), F.col("hub.label").alias("hub_label"))
    best = dealt.join(hubs.hint("shuffle_hash"), "sig").where("label <> hub_label").groupBy("class", "hub").count()
    return best.groupBy("class").agg(F.max(F.struct("count", "hub")).alias("x")).select(F.col("class").alias("a"), F.col("x.hub").alias("b"))


def described_pairs(pairs: DataFrame, known: DataFrame, links: Column) -> DataFrame:
    """a, b, doc_a, doc_b of the pairs (a, b) that links, on known's columns under the aliases a and b, lets pass."""
    a, b = known.alias("a"), known.alias("b")
    both = pairs.alias("p").join(a, F.col("p.a") == F.col("a.class")).join(b, F.col("p.b") == F.col("b.class")).where(links)
    return both.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("a.at").alias("doc_a"), F.col("b.at").alias("doc_b"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id of each row of docs (doc_id, text; more columns are ignored).

    Sets of shingles of size words link at percent or more. component_id is the least doc_id that links lead to, class_id the least doc_id with an equal set. Null or empty text, and
    text without words, is an empty set, which links with nothing. Every row is a document of its own: rows that repeat share a component, rows of one doc_id with
    other texts each have the component of their text, and rows without doc_id link as the others do (a component of such rows alone has no
    component_id). Texts are read whole, however long. An empty table gives no rows.
    """
    return grouped(docs, percent, size).drop("hash", "label")


def grouped(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """near_duplicates() with hash, xxhash64 of the text, and label, which names the component of every row with words, with or without doc_id."""
    rows = written(described(docs, size), "sets")
    at = place_of(F.col("doc_id"), F.col("hash"))
    classes = written(rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc"), F.min(at).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "classes")
    n_classes = classes.count()
    made = []
    for part in range(DEALS):
        dealt = signed(docs, percent, size, part, DEALS).select(F.explode("sigs").alias("sig"), "class").repartition("sig")
        shared = dealt.groupBy("sig").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("sig")
        made.append(written(dealt.join(shared.hint("shuffle_hash"), "sig").distinct(), "buckets"))
    buckets = reduce(DataFrame.unionByName, made)
    known = classes.select("class", "at", "n", "sketch", "wide")
    wide = may_link_wide("a", "b", percent)

    links = labels = tried = None
    rows_left = buckets
    for turn in range(MOST_ROUNDS):
        if labels is not None:  # a signature that is settled stays so
            before, rows_left = made, written(unsettled(rows_left, labels), "unsettled")
            made = [rows_left]
            dropped(*before)
        pairs = hub_pairs(rows_left.withColumn("label", F.col("class")) if labels is None else rows_left, turn, n_classes)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "hub-pairs")
        found = verified(described_pairs(pairs, known, may_link("a", "b", percent) & wide), docs, percent, size)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = written(components(links), "labels")
        if not found.limit(1).collect():
            break
    # What shares a signature across components still.
    rest = written(unsettled(rows_left, labels).join(known.select("class", "n", "sketch"), "class"), "open")
    dropped(*made)
    a, b = rest.alias("a"), rest.alias("b")
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.class") < F.col("b.class")) & (F.col("a.label") != F.col("b.label")) & may_link("a", "b", percent))
    pairs = written(pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct(), "open-pairs")
    dropped(rest)
    links = links.unionByName(verified(described_pairs(pairs, known.drop("sketch"), wide), docs, percent, size))
    labels = components(links)
    dropped(pairs)

    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "doc", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "label").select("class", F.col("doc").alias("class_id"), "component_id", "label")
    out = rows.select("doc_id", "hash", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(named, "class", "left")
    return out.select("doc_id", "hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "label")
