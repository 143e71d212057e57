"""Suffix-array dedup: column-wise construction over many strings at once.

Every window of LENGTH bytes has an anchor, the place in it whose GRAM bytes hash lowest (the first of equal ones). Equal
windows have equal anchors at equal places, so only strings round a common anchor can share a window; a string is what the
windows of one anchor cover, and strings line up at their anchors. Equal strings are one from the start.

The strings of an anchor then go through a column-wise construction: from the last column to the first, each round inserts
one symbol of every string. The symbols in the order so far are the open column's part of the collection's Burrows-Wheeler
transform (what stands before each suffix); a stable sort by them gives the next order, and the longest common prefixes of neighbours
follow from the ranges between them. As strings line up at their anchors, only suffixes of one column are ever
compared, so the transform of earlier columns is not kept. A suffix with LENGTH symbols in common with a neighbour starts a
window that occurs elsewhere. An anchor with more than BATCH different strings would be too much for a task: there
the windows of each string are counted by their hashes.

Passages of words go the same way, over texts of three bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, blocks, dropped, prefix_sums, range_hashes, raw_strings, words, written

LENGTH, GRAM = 400, 32
#: Strings that are sorted together at most; bytes of a text that are looked at together.
BATCH, PIECE = 8192, 1 << 18
#: Bytes of a word's code, and words that choose an anchor among passages.
CODE, GRAM_WORDS = 3, 8

#: start: the first place of the string in the text; more: the other ones, where a text repeats it (null if it doesn't).
ANCHORS = "anchor bigint, k1 bigint, k2 bigint, start bigint, size int, shift int, string bigint, n bigint, more array<bigint>"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text number, anchor's hash, start, size and shift (the anchor's place in it) and hash of each string; under 2**20 bytes of texts."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    sums = prefix_sums(BYTE_CODES[data])
    n = len(data) - gram + 1
    place = np.arange(n)
    grams = range_hashes(sums, place, place + gram)
    low = np.uint64((1 << 20) - 1)
    least = (sliding_min((grams & ~low) | place.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    sizes = np.diff(offsets)
    ok = np.zeros(len(data) + 1, np.int64)  # window starts inside a text
    long = sizes >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, offsets[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(ok)[: len(least)] > 0)
    if not len(starts):
        return none, none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    at = least[starts]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    lo, hi = starts[heads], starts[np.append(heads[1:], len(starts)) - 1] + length
    doc, at = doc[heads], at[heads]
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    string = np.fromiter((digest(view[i:j]) for i, j in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo)) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64)
    return doc, grams[at], lo - offsets[doc], hi - lo, at - lo, string


def anchored(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """The strings of keyed (k1, k2, text): see ANCHORS."""
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for lo, hi in blocks(offsets, PIECE):
                whole = data[offsets[lo] : offsets[hi]]
                for at in range(0, max(1, len(whole) - length + 1), PIECE) if hi == lo + 1 else (0,):
                    piece = whole[at : at + PIECE + length - 1] if hi == lo + 1 else whole
                    ends = np.array([0, len(piece)]) if hi == lo + 1 else offsets[lo : hi + 1] - offsets[lo]
                    doc, anchor, start, size, shift, string = anchors(piece, ends, length, gram)
                    # Text that runs on in a short period has one string many times: one row for them.
                    order = np.lexsort((start, string, anchor, doc))
                    doc, anchor, start, size, shift, string = (x[order] for x in (doc, anchor, start, size, shift, string))
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (string[1:] != string[:-1])
                    head = np.flatnonzero(new)
                    n = np.diff(np.append(head, len(doc)))
                    more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - 1)), pa.int32()), pa.array(start[~new] + at, pa.int64()), mask=pa.array(n == 1))
                    doc = doc[head]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor[head].view(np.int64)), pa.array(k1[lo + doc]), pa.array(k2[lo + doc]), pa.array(start[head] + at), pa.array(size[head], pa.int32()),
                            pa.array(shift[head], pa.int32()), pa.array(string[head].view(np.int64)), pa.array(n), more,
                        ],
                        names=names,
                    )

    return keyed.mapInArrow(run, ANCHORS)


def column_wise(strings: list[bytes], shifts: np.ndarray, groups: np.ndarray, length: int, gram: int, docs: np.ndarray | None = None) -> np.ndarray:
    """Which starts of windows occur in another string of the group at the same place before the anchor: a row for each string, a column for each start.

    Column j of the grid is the place j - (length - gram) from the anchor; groups are sorted. docs: the document of each string, or
    -1 for several; if given, a window must occur in two documents.
    """
    m, width, reach = len(strings), 2 * length - gram, length - gram
    found = np.zeros((m, reach + 1), bool)
    grid = np.full((width, m), -1, np.int16)
    for i, (s, shift) in enumerate(zip(strings, shifts.tolist())):
        grid[reach - shift : reach - shift + len(s), i] = np.frombuffer(s, np.uint8)
    group = np.cumsum(np.concatenate([[0], (groups[1:] != groups[:-1]).astype(np.int64)])) * 257
    order, common = np.arange(m), np.zeros(m, np.int64)  # common[i]: of the suffixes at i - 1 and i
    for j in range(width - 1, -1, -1):
        symbol = grid[j][order]  # of the suffixes so far, in their order: what stands before each
        key = group[order] + symbol
        same = np.zeros(m, bool)
        if (key[1:] >= key[:-1]).all():
            between = common
            same[1:] = (key[1:] == key[:-1]) & (symbol[1:] >= 0)
        else:
            place = np.argsort(key, kind="stable")
            key, symbol, order = key[place], symbol[place], order[place]
            same[1:] = (key[1:] == key[:-1]) & (symbol[1:] >= 0)
            between = np.zeros(m, np.int64)
            near = np.zeros(m, bool)
            near[1:] = same[1:] & (place[1:] == place[:-1] + 1)
            between[near] = common[place[near]]
            far = np.flatnonzero(same & ~near)
            if len(far):  # the least of those between, for all at once
                ends = np.stack([place[far - 1] + 1, place[far] + 1], axis=1)
                by_start = np.argsort(ends[:, 0], kind="stable")
                between[far[by_start]] = np.minimum.reduceat(np.append(common, 0), ends[by_start].reshape(-1))[::2]
        common = np.where(same, between + 1, 0)
        if j <= reach:
            hit = common >= length
            if not hit.any():
                continue
            if docs is None:
                hit[:-1] |= common[1:] >= length
            else:  # a run of equal windows, in two documents
                heads = np.flatnonzero(~hit)
                doc = docs[order]
                low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
                sizes = np.diff(np.append(heads, m))
                hit = np.repeat((sizes > 1) & ((low < high) | (low == -1)), sizes)
            found[order[hit], j] = True
    return found


def covered(starts: np.ndarray, length: int) -> list[int]:
    """Flat start, end, start, end ... of what windows at starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    lo, hi = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + length
    return np.stack([lo, hi], axis=1).reshape(-1).tolist()


def repeated_parts(rows: DataFrame, length: int, gram: int, most: int = BATCH, across: bool = False) -> DataFrame:
    """(anchor, string, parts) of rows (anchor, string, shift, doc, data), dealt and sorted by anchor, with most strings an anchor: what other strings (across: of other documents) share, as covered() says."""
    schema = pa.schema([("anchor", pa.int64()), ("string", pa.int64()), ("parts", pa.list_(pa.int64()))])

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        shift, group = table.column("shift").to_numpy().astype(np.int64), table.column("anchor").to_numpy()
        found = column_wise(table.column("data").to_pylist(), shift, group, length, gram, table.column("doc").to_numpy() if across else None)
        parts = []
        for i in range(len(shift)):
            parts.append(covered(np.flatnonzero(found[i]) - (length - gram - int(shift[i])), length))
        return pa.RecordBatch.from_arrays([table.column("anchor").combine_chunks(), table.column("string").combine_chunks(), pa.array(parts, pa.list_(pa.int64()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                group = batch.column("anchor").to_numpy()
                if n and n >= most:  # go on to the end of the open anchor only
                    last = held[-1].column("anchor")[-1].as_py()
                    end = int(np.argmax(group != last)) if (group != last).any() else len(group)
                    if end:
                        held.append(batch.slice(0, end))
                        n += end
                        batch = batch.slice(end)
                        continue
                    yield solve(held)
                    held, n = [], 0
                take = min(batch.num_rows, max(1, most - n))
                held.append(batch.slice(0, take))
                n += take
                batch = batch.slice(take)
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "anchor bigint, string bigint, parts array<bigint>")


def counted_parts(rows: DataFrame, length: int, gram: int, across: bool = False) -> DataFrame:
    """repeated_parts() for anchors of any number of strings: each window is counted by its hash, so that no task needs an anchor's strings together."""
    schema = pa.schema([("anchor", pa.int64()), ("string", pa.int64()), ("shift", pa.int32()), ("doc", pa.int64()), ("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                row, start, windows = [], [], []
                for i, s in enumerate(part.column("data").to_pylist()):
                    n = len(s) - length + 1
                    row += [i] * n
                    start += range(n)
                    windows += [digest(s[k : k + length]) for k in range(n)]
                take, w = pa.array(row, pa.int64()), np.frombuffer(b"".join(windows), np.int64).reshape(-1, 2)
                at = np.array(start, np.int32) - part.column("shift").to_numpy()[row].astype(np.int32) if row else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("anchor", "string", "shift", "doc")), pa.array(at), pa.array(w[:, 0]), pa.array(w[:, 1])], schema=schema)

    windows = written(rows.select("anchor", "string", "shift", "doc", "data").mapInArrow(run, "anchor bigint, string bigint, shift int, doc bigint, at int, w1 bigint, w2 bigint"), "windows")
    key = ["anchor", "at", "w1", "w2"]
    often = windows.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("n > 1" + (" and (lo < hi or lo = -1)" if across else ""))
    hits = windows.join(often.select(*key), key, "left_semi").groupBy("anchor", "string", "shift").agg(F.sort_array(F.collect_set("at")).alias("at"))  # a string has under 2 * length windows
    parts = F.flatten(F.transform("at", lambda x: F.array((x + F.col("shift")).cast("bigint"), (x + F.col("shift") + length).cast("bigint"))))
    return hits.select("anchor", "string", parts.alias("parts"))


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id and text: rows alike in doc_id and text share a key, which does no harm, as their texts are equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), doc_id.alias("doc_id"), text.alias("text"))


def word_codes(texts: DataFrame) -> DataFrame:
    """texts (k1, k2, text) with CODE bytes of each word's hash for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets):
                _, _, h, first = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                codes = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :CODE])
                coded = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((first * CODE).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("k1").slice(lo, hi - lo), batch.column("k2").slice(lo, hi - lo), coded], names=["k1", "k2", "text"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 bigint, text binary")


def removals(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, across: bool = False) -> DataFrame:
    """(k1, k2, cuts), written: for each key of texts (k1, k2, text), flat start, end, ... byte ranges that windows which occur elsewhere (across: in another document) cover, unmerged."""
    found = anchored(texts.select("k1", "k2", "text"), length, gram)
    often = written(found.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1").select("anchor"), "anchors-often")
    seen = written(found.join(often, "anchor", "left_semi"), "anchors")
    dropped(often)
    doc = F.shiftrightunsigned(F.xxhash64("k1", "k2"), 1)
    strings = seen.groupBy("anchor", "string").agg(F.sum("n").alias("n"), F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.min(F.struct("k1", "k2", "start", "size", "shift")).alias("at"))
    strings = written(strings.withColumn("whole", F.col("lo") < F.col("hi") if across else F.col("n") > 1), "strings")
    several = strings.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    others = strings.join(several, "anchor")
    one = F.struct("anchor", "string", F.col("at.start").alias("start"), F.col("at.size").alias("size"), F.col("at.shift").alias("shift"), F.when(F.col("lo") < F.col("hi"), F.lit(-1)).otherwise(F.col("lo")).alias("doc"), (F.col("m") > batch).alias("hot"))
    asked = others.select(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"), one.alias("one"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("one").alias("asked"))
    fields = [("anchor", pa.int64()), ("string", pa.int64()), ("shift", pa.int32()), ("doc", pa.int64()), ("hot", pa.bool_()), ("data", pa.binary())]
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                asked = part.column("asked")
                one = asked.flatten()
                row = np.repeat(np.arange(len(part)), asked.value_lengths().to_numpy())
                at = offsets[lo + row] + one.field("start").to_numpy()
                size = one.field("size").to_numpy()
                pieces = [data[i : i + n].tobytes() for i, n in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([*(one.field(c) for c, _ in fields[:-1]), pa.array(pieces, pa.binary())], schema=schema)

    # A key may stand for several equal rows: each string is wanted once.
    one_text = texts.select("k1", "k2", "text").join(asked, ["k1", "k2"])
    pieces = one_text.select("text", "asked").mapInArrow(cut, "anchor bigint, string bigint, shift int, doc bigint, hot boolean, data binary").dropDuplicates(["anchor", "string"])
    hot = several.where(F.col("m") > batch).limit(1).collect()
    if hot:
        pieces = written(pieces, "pieces")
    parts = repeated_parts((pieces.where("not hot") if hot else pieces).repartition("anchor").sortWithinPartitions("anchor"), length, gram, batch, across)
    if hot:
        parts = parts.unionByName(counted_parts(pieces.where("hot"), length, gram, across))
    parts = written(parts, "parts")
    known = strings.join(parts, ["anchor", "string"], "left")
    known = written(known.select("anchor", "string", "whole", F.when(~F.col("whole"), F.col("parts")).alias("parts")).where("whole or size(parts) > 0"), "known")
    cuts = seen.select("anchor", "string", "k1", "k2", "start", "size", "more").join(known, ["anchor", "string"])
    own = F.when(F.col("whole"), F.array(F.lit(0).cast("bigint"), F.col("size").cast("bigint"))).otherwise(F.col("parts"))
    starts = F.when(F.col("more").isNull(), F.array("start")).otherwise(F.concat(F.array("start"), "more"))
    cuts = cuts.select("k1", "k2", own.alias("own"), starts.alias("starts"))
    cuts = cuts.select("k1", "k2", F.flatten(F.transform("starts", lambda s: F.transform("own", lambda x: x + s))).alias("cuts"))
    out = written(cuts.groupBy("k1", "k2").agg(F.flatten(F.collect_set("cuts")).alias("cuts")), "cuts")
    dropped(seen, strings, parts, known, *([pieces] if hot else []))
    return out


def merged(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges [cuts[0], cuts[1]), [cuts[2], cuts[3]), ..."""
    lo, hi = cuts[::2], cuts[1::2]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    heads = np.flatnonzero(new)
    return lo[heads], hi[np.append(heads[1:], len(lo)) - 1]


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, passage_words: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text; more columns are ignored) without the bytes that a string of `length` bytes covers which also starts elsewhere.

    Strings are judged on the whole UTF-8 texts as they come, matches in one document and overlapping ones included; none
    crosses documents. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the
    remaining bytes, joined). With passage_words also n_passages and n_passage_words: the runs of words (as near-duplicate operators
    read them) that passages of so many words cover which another document has too, and the words in them; nothing is removed for
    these. Null and empty texts, and those under `length` bytes, lose nothing. Texts are read whole, however long. Rows that repeat lose each
    what is long enough, and alike in doc_id and text they are one document to passages. An empty table gives no rows.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be from 1 to length")
    texts = keyed(docs)
    lists = removals(texts, length, gram, batch)
    if passage_words:
        codes = written(word_codes(texts), "word-codes")
        passages = removals(codes, CODE * passage_words, CODE * min(GRAM_WORDS, passage_words), batch, across=True)
        dropped(codes)
        lists = lists.join(passages.withColumnRenamed("cuts", "passages"), ["k1", "k2"], "full")
    else:
        lists = lists.withColumn("passages", F.lit(None).cast("array<bigint>"))
    rows = texts.join(lists, ["k1", "k2"], "left").select("doc_id", "text", "cuts", "passages")
    names = ["n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets, 4 << 20):
                out = []
                for i, c, p in zip(range(lo, hi), batch.column("cuts").slice(lo, hi - lo), batch.column("passages").slice(lo, hi - lo)):
                    text = data[offsets[i] : offsets[i + 1]]
                    n, spans = len(text), 0
                    if c.is_valid and len(c.values):
                        a, b = merged(c.values.to_numpy())
                        edge = np.zeros(n + 1, np.int32)
                        edge[a] += 1
                        edge[b] -= 1
                        keep = np.cumsum(edge)[:-1] == 0
                        text, spans = text[keep], len(a)
                    a, b = merged(p.values.to_numpy()) if p.is_valid and len(p.values) else (np.zeros(0, np.int64),) * 2
                    kept = text.tobytes()
                    out.append((n, n - len(kept), spans, len(a), int((b - a).sum()) // CODE, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x, f.type) for x, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    out = rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in names) + ", kept_sha256 string, kept binary")
    return out if passage_words else out.drop(*names[3:])
