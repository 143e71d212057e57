"""Substring dedup of words: difference-cover anchors.

A difference cover of a period v is a set of residues whose differences are all residues of v. Two equal windows of `length`
words, wherever they start, then have places a and b at the same distance (under v) from their starts that both lie on the
cover, and share the length - v + 1 words from there on: the anchor. So anchors are hashed at cover positions only (5 of 21 places
for windows of 35 words), and nothing but what surrounds an anchor that stands twice can hold a match.

Such an anchor is extended by all words that a window over it can reach, its context (v - 1 words before it, length words from it
on, less at a text's ends). Copies share whole contexts, which are counted by hash; every word of a context that stands twice is
covered. Of an anchor with different contexts one place each goes back to its text, whose windows over the anchor are counted. All counts are plain
aggregates, so that a passage in a third of all texts is pre-aggregated where it is read and never gathered in a task.

Words, anchors, contexts and windows are compared by hashes: an anchor and its context, and a window, by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, dropped, mix, raw_strings, spread, text_words, written

LENGTH = 35

#: Perfect difference sets: fixed values, each residue of the period but 0 is one difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_of(length: int) -> tuple[int, tuple[int, ...]]:
    """The period and the cover for windows of so many words: anchors keep a third of a window at least."""
    period = max(v for v in COVERS if v == 1 or 3 * v <= 2 * length + 2)
    return period, COVERS[period]


_LEFT, _SEED = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` words in a row, from hashes of runs of half as many words, each time mixed anew."""
    n = 1
    while 2 * n <= size and len(h) > n:
        h = mix(h[:-n] * _LEFT + h[n:])
        n *= 2
    rest = size - n
    if rest <= 0:
        return h
    return mix(h[:-rest] * _LEFT + h[rest:]) if len(h) > rest else h[:0]


def texts_of(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id and text; rows alike in doc_id and text share the key (k1, k2), which does no harm, as their words are equal."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def _places(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions among the words of texts of `length` words or more, and the text of each: those from which a whole anchor follows."""
    period, cover = cover_of(length)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    on = np.zeros(period, bool)
    on[list(cover)] = True
    local = np.arange(len(h)) - first[text]
    at = np.flatnonzero(on[local % period] & (local + (length - period + 1) <= counts[text]) & (counts[text] >= length))
    return at, text[at]


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """anchor: the hash at each cover position of texts."""
    size = length - cover_of(length)[0] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                _, _, h, first = text_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=False)
                at, _ = _places(h, first, length)
                yield pa.RecordBatch.from_arrays([pa.array(run_hashes(h, size)[at].view(np.int64))], names=["anchor"])

    return texts.select("text").mapInArrow(run, "anchor bigint")


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """anchor, context (a hash of all the words that windows over the anchor reach), k1, k2 and place of each cover position."""
    period = cover_of(length)[0]
    names = ["anchor", "context", "k1", "k2", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                _, _, h, first = text_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=False)
                at, text = _places(h, first, length)
                place = at - first[text]
                before, after = np.minimum(place, period - 1), np.minimum(first[text + 1] - at, length)
                whole = run_hashes(mix(h + _SEED), length)  # two windows make up the context: it has under twice their words
                context = mix(whole[at - before] * _LEFT + whole[at + after - length]) + (before * (length + 1) + after).astype(np.uint64) * _SEED
                take = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays([pa.array(run_hashes(h, length - period + 1)[at].view(np.int64)), pa.array(context.view(np.int64)), batch.column("k1").take(take), batch.column("k2").take(take), pa.array(place)], names=names)

    return texts.select("k1", "k2", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def windows(asked: DataFrame, length: int) -> DataFrame:
    """w1, w2 (128 bits), k1, k2 and start of each window over an asked anchor: asked has k1, k2, text and places, the anchors."""
    period = cover_of(length)[0]
    names = ["w1", "w2", "k1", "k2", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                _, _, h, first = text_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=False)
                places = batch.column("places").slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), places.value_lengths().to_numpy())
                at = first[text] + places.flatten().to_numpy()
                edge = np.zeros(len(h) + 1, np.int64)  # starts that reach an anchor and end in the text
                np.add.at(edge, np.maximum(at - period + 1, first[text]), 1)
                np.add.at(edge, np.minimum(at, first[text + 1] - length) + 1, -1)
                start = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                text = np.searchsorted(first, start, side="right") - 1
                take = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays([*(pa.array(run_hashes(x, length)[start].view(np.int64)) for x in (h, mix(h + _SEED))), batch.column("k1").take(take), batch.column("k2").take(take), pa.array(start - first[text])], names=names)

    return asked.select("k1", "k2", "text", "places").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def removals(texts: DataFrame, length: int) -> DataFrame:
    """k1, k2 and cuts of texts, written: p stands for the window at p, -1 - p for the context of the anchor at p; all of their words stand elsewhere too."""
    often = written(anchors(texts, length).groupBy("anchor").count().where("count > 1").select("anchor"), "word-anchors")
    seen = written(contexts(texts, length).join(often, "anchor", "left_semi"), "word-contexts")
    dropped(often)
    each = written(seen.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one")), "word-extensions")
    copies = seen.join(each.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("k1", "k2", (-1 - F.col("place")).alias("cut"))
    several = each.groupBy("anchor").count().where("count > 1").select("anchor")
    asked = each.join(several, "anchor", "left_semi").groupBy("one.k1", "one.k2").agg(F.collect_set("one.place").alias("places"))
    found = written(windows(texts.join(asked, ["k1", "k2"]), length), "word-windows")
    again = found.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    cuts = copies.unionByName(found.join(again, ["w1", "w2"], "left_semi").select("k1", "k2", F.col("start").alias("cut")))
    out = written(cuts.groupBy("k1", "k2").agg(F.collect_set("cut").alias("cuts")), "word-cuts")
    dropped(seen, each, found)
    return out


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each row of docs (doc_id, text; more columns are ignored) without the words that a window of `length` words covers which also starts elsewhere.

    Words are runs of anything but \\x20 and \\x09-\\x0D, unchanged. Windows are judged on the whole texts as they come, matches
    in one text and overlapping ones included; none crosses texts. Returns doc_id, n_words, n_removed, kept_sha256 and kept (the other words, joined
    by one space). Null, empty and blank texts have no words, and texts under `length` words lose none. Rows that repeat lose each what is long
    enough, also under one doc_id or none. Texts are read whole, however long. An empty table gives no rows.
    """
    if length < 1:
        raise ValueError("length must be positive")
    period = cover_of(length)[0]
    texts = texts_of(docs)
    rows = texts.join(removals(texts, length), ["k1", "k2"], "left").select("doc_id", "text", "cuts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                start, end, _, first = text_words(part, offsets[lo : hi + 1] - offsets[lo], lower=False)
                cuts = batch.column("cuts").slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), cuts.fill_null([]).value_lengths().to_numpy())
                cut = cuts.drop_null().flatten().to_numpy()
                context = cut < 0
                from_, to = np.where(context, -cut - period, cut) + first[text], np.where(context, -1 - cut, cut) + length + first[text]
                edge = np.zeros(len(start) + 1, np.int64)
                np.add.at(edge, np.maximum(from_, first[text]), 1)
                np.add.at(edge, np.minimum(to, first[text + 1]), -1)
                keep = np.cumsum(edge)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[first]
                start, size = start[keep], (end - start)[keep] + 1
                joined = np.append(part, np.uint8(32))[spread(start, size)]  # each word and the byte after it
                ends = np.cumsum(size)
                joined[ends - 1] = 32
                bounds = np.concatenate([[0], ends])[kept]
                out = [joined[a : max(a, b - 1)].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(kept)), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
