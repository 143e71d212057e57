"""Benchmark decontamination by spaced seeds.

A seed hashes the words at the places of a fixed mask and ignores those between, so that a substituted word in a gap does
not hide an overlap. The seeds of the benchmark's items are joined with those at every place of every document; around
each hit, document and item are laid along the hit's diagonal, and the best segment (a match counts 1, a substitution
-SUBSTITUTION) decides. The masks miss nothing that is accepted: a segment in which more than two thirds of the words match, as a
gain takes, has four words in a row that match, or three with a single gap and another one beside them; the mask with a gap in the middle is for
items of 5 to 12 words. Items go to the executors in blocks of bounded size, each joined with all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mask_hashes, raw_strings, spread, words, written

# Four masks of four words; shorter items are looked for whole.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4), (0, 1, 3, 4))
SPAN, SHORTEST = 5, 3
#: Pairs of places with equal seeds that are looked at together.
HITS_AT_ONCE = 1 << 21
#: An overlap counts with so many matching words, or with this share of the item's words.
MIN_WORDS, MIN_SHARE, SUBSTITUTION = 13, 0.8, 2
#: Characters of benchmark text in a block: a block's seeds take under 100 MB in a worker.
BLOCK_CHARS = 8_000_000

HITS = "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint, n_matches bigint, share double"

_SOLID_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits of texts in lower case, and the first one's index of each text."""
    _, _, h, first = words(np.where(_SOLID_WORD[data], data, 0x20).astype(np.uint8), offsets)
    return h, first


class Index:
    """The seeds of a block of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = raw_strings(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.words, self.first = plain_words(data, offsets)
        counts = np.diff(self.first)
        self.masks = [*MASKS, tuple(range(SHORTEST))]  # items of four words fit the first mask, those of three the last
        seeds, places = [], []
        for mask in self.masks:
            every = mask_hashes(self.words, mask)
            span = mask[-1] + 1
            fits = counts >= max(span, SPAN - 1) if len(mask) == 4 else counts == span
            at = spread(self.first[:-1][fits], counts[fits] - span + 1)
            seeds.append(every[at] if len(at) else np.zeros(0, np.uint64))
            places.append(at)
        seeds, places = np.concatenate(seeds), np.concatenate(places)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in h, place in the items' words) of every seed that both have, HITS_AT_ONCE at most if no single place has more."""
        for mask in self.masks:
            every = mask_hashes(h, mask)
            at = np.flatnonzero(self.sieve[(every >> np.uint64(44)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.seeds, every[at], side=s) for s in ("left", "right"))
            some = hi > lo
            at, lo, hi = at[some], lo[some], hi[some]
            total = np.cumsum(hi - lo)
            k = 0
            while k < len(at):
                end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + HITS_AT_ONCE, side="right")))
                yield np.repeat(at[k:end], (hi - lo)[k:end]), self.places[spread(lo[k:end], (hi - lo)[k:end])]
                k = end


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """start, end and matches of the segment with most matches less SUBSTITUTION for each other word; of equal ones the earliest start and end."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    gain = total - np.minimum.accumulate(total)
    end = int(np.argmax(gain))
    start = int(np.argmin(total[: end + 1])) if end else 0
    return start, end, int(same[start:end].sum())


def overlaps(h: np.ndarray, first: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int, float]]:
    """(text number, item number, start in the text, start in the item, words, matches, share) of the best overlap of each pair."""
    items, far = len(index.ids), int(max(np.diff(first).max(initial=0), np.diff(index.first).max(initial=0))) + 1
    diagonals = np.zeros(0, np.int64)  # different ones, as (text, item, shift) in one number
    for left, right in index.hits(h):
        doc, item = np.searchsorted(first, left, side="right") - 1, index.item[right]
        shift = (left - first[doc]) - (right - index.first[item])
        diagonals = np.union1d(diagonals, (doc * items + item) * (2 * far) + shift + far)
    pair, shift = np.divmod(diagonals, 2 * far)
    found: dict[tuple[int, int], tuple[int, int, int, int, float]] = {}
    for d, i, s in zip((pair // items).tolist(), (pair % items).tolist(), (shift - far).tolist()):
        a, b = h[first[d] : first[d + 1]], index.words[index.first[i] : index.first[i + 1]]
        lo, hi = max(0, -s), min(len(b), len(a) - s)
        if hi <= lo:
            continue
        start, end, n = best_segment(a[lo + s : hi + s] == b[lo:hi])
        share = n / len(b)
        if n >= MIN_WORDS or share >= MIN_SHARE:
            found[d, i] = max(found.get((d, i), (0, 0, 0, 0, 0.0)), (n, -(lo + start + s), lo + start, end - start, share))
    return [(d, i, -p, q, w, n, share) for (d, i), (n, p, q, w, share) in found.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The overlaps of docs (doc_id, text) with benchmark (item_id, text): see HITS. More columns are ignored.

    A row for each document and item that overlap in MIN_WORDS matching words or more, or in MIN_SHARE of the item; of
    several places in a document, the one with most matches, the first of equal ones. Words are runs of letters and
    digits in lower case. Null or empty texts, and items under SHORTEST words, overlap with nothing; an item under SPAN
    words must occur whole. Texts are read whole, however long. Rows that repeat give a row each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int64()) for c in ("doc_start", "item_start", "n_words", "n_matches")), ("share", pa.float64())])
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))

    def of_block(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in batches:
                index = index or Index(*sent.value)
                data, offsets = raw_strings(batch.column("text"))
                for lo, hi in blocks(offsets):
                    h, first = plain_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    rows = overlaps(h, first, index)
                    if rows:
                        d, i, *rest = zip(*rows)
                        ids = batch.column("doc_id").take(pa.array([lo + x for x in d]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([None if index.ids[x] == NO_ID else int(index.ids[x]) for x in i], pa.int64()), *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[2:]))], schema=schema)

        return texts.mapInArrow(run, HITS)

    parts, block, chars = [], [], 0
    for r in items.where(F.length("text") > 0).select(F.coalesce("item_id", F.lit(NO_ID)).alias("item_id"), "text").toLocalIterator():  # a block at a time
        block.append(r)
        chars += len(r["text"])
        if chars >= block_chars:
            parts.append(of_block(block))
            block, chars = [], 0
    if block:
        parts.append(of_block(block))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HITS)


#: Stands for a null item_id.
NO_ID = -(1 << 63)


#: Ids that are broadcast at most (8 bytes each).
MAX_BROADCAST_IDS = 1_000_000


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a passage of the benchmark; of rows with one doc_id, all go if one does. Null ids stay."""
    bad = written(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= MAX_BROADCAST_IDS else bad
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
