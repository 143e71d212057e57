"""Chroma audio fingerprints.

Frames hold the energy of 12 pitch classes. Over a sliding window of them, 16 rectangle filters compare sums read off an
integral image; each comparison is cut into four levels, Gray-coded into two bits, and the 16 pairs are one packed integer a
frame. Recordings with equal integers are one class. Keys of a few neighbouring integers, thinned to the least hash in each
stretch, find recordings that may share sound; the differences of their places make an offset histogram, and at its
peaks, the highest first, the bit errors over the whole overlap say whether the recordings align.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mask_hashes, mix, raw_strings, written
from .graph import components

PITCHES, WINDOW, KEY, STRETCH = 12, 16, 4, 16
#: Marks of one key that a task holds against all marks of the key.
MARKS_A_PART = 1000
#: Bit errors a bit that recordings may have, and frames they must share.
MOST_ERRORS, LEAST_OVERLAP = 0.15, 12
#: Weights of the five frames that smooth one; the levels of a comparison.
SMOOTH, LEVELS = (0.25, 0.75, 1.0, 0.75, 0.25), (-0.4, 0.0, 0.4)


#: Columns that are made here; recordings' own of these names are dropped.
ADDED = ("class", "ints", "landmarks", "class_id", "n_frames", "group_id", "n_links", "match_id", "offset", "overlap", "bit_error")


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch, pitches, frames) of the 16 filters, by rule: each kind with narrow and wide, low and high rectangles."""
    out = []
    for k in range(16):
        height, width = (2, 4, 6, 12)[(k // 4 + k) % 4], (2, 4, 8, 16)[k // 4]
        out.append((k % 4 if width > 2 or k % 4 != 3 else 1, (5 * k) % (PITCHES - height + 1), height, width))
    return out


FILTERS = filters()


def chroma_of_samples(samples: np.ndarray, rate: int, frame: int = 4096, hop: int = 1365) -> np.ndarray:
    """Pitch-class frames of PCM samples: windowed spectra, whose energies from 28 to 3520 Hz go to the nearest pitch class."""
    if len(samples) < frame:
        return np.zeros((0, PITCHES))
    view = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float64), frame)[::hop]
    power = np.abs(np.fft.rfft(view * np.hamming(frame), axis=1)) ** 2
    hertz = np.fft.rfftfreq(frame, 1 / rate)
    used = (hertz >= 28) & (hertz <= 3520)
    pitch = np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % PITCHES
    out = np.zeros((len(power), PITCHES))
    for p in range(PITCHES):
        out[:, p] = power[:, used][:, pitch == p].sum(axis=1)
    return out


def chroma_of_bytes(data: np.ndarray, hop: int = 4) -> np.ndarray:
    """Pitch-class frames of a score written as bytes: each byte is a note with two overtones, hop bytes are a frame. It stands in for sound where tables have none."""
    n = len(data) // hop
    note = (data[: n * hop].astype(np.int64) * 7) % PITCHES
    out = np.zeros(n * PITCHES)
    frame = np.repeat(np.arange(n), hop) * PITCHES
    for step, weight in ((0, 1.0), (7, 0.5), (4, 0.25)):
        out += np.bincount(frame + (note + step) % PITCHES, weights=np.full(n * hop, weight), minlength=n * PITCHES)
    return out.reshape(n, PITCHES)


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """The packed integers (unsigned 32 bits) of frames x 12 energies: one for each place of the window."""
    n = len(chroma) - len(SMOOTH) + 1
    if n < WINDOW:
        return np.zeros(0, np.uint32)
    smooth = sum(w * chroma[i : i + n] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    image = np.divide(smooth, norm, out=np.zeros_like(smooth), where=norm > 1e-9)
    total = np.zeros((n + 1, PITCHES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    m = n - WINDOW + 1

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        a, b = total[x : x + m], total[x + w : x + w + m]
        return b[:, y + h] - a[:, y + h] - b[:, y] + a[:, y]

    out = np.zeros(m, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind == 0:  # lower against higher pitches
            plus, minus = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif kind == 1:  # earlier against later
            plus, minus = area(0, y, w // 2, h), area(w // 2, y, w // 2, h)
        elif kind == 2:  # the quarters crosswise
            plus = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w // 2, h - h // 2)
            minus = area(w // 2, y, w // 2, h // 2) + area(0, y + h // 2, w // 2, h - h // 2)
        else:  # the middle in time against its sides
            plus, minus = area(w // 4, y, w // 2, h), area(0, y, w // 4, h) + area(w // 4 + w // 2, y, w // 4, h)
        level = np.digitize(np.log((1 + plus) / (1 + minus)) * 4, LEVELS).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def landmarks(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the KEY neighbouring integers with the least hash in each STRETCH of places: all of the fingerprint's keys if it is shorter."""
    keys = mask_hashes(mix(ints.astype(np.uint64) + np.uint64(1)), tuple(range(KEY)))
    if len(keys) <= STRETCH:
        return keys, np.arange(len(keys))
    view = np.lib.stride_tricks.sliding_window_view(keys, STRETCH)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return keys[at], at


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """Frames that overlap if b is laid offset frames into a, and the share of their bits that differ."""
    lo, hi = max(0, offset), min(len(a), offset + len(b))
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).sum()) / (32 * (hi - lo))


def fingerprinted(recordings: DataFrame, column: str, frames) -> DataFrame:
    """recordings (key columns, and column with text or binary sound) with class, ints (binary, 32 bits each), n_frames and landmarks."""
    keys = [c for c in recordings.columns if c != column]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_strings(batch.column(column))
            for lo, hi in blocks(offsets):
                rows = []
                for i in range(lo, hi):
                    ints = fingerprint(frames(data[offsets[i] : offsets[i + 1]]))
                    key, place = landmarks(ints)
                    name = int(mix(np.array([mix(ints.astype(np.uint64) + np.uint64(7) * np.arange(1, len(ints) + 1, dtype=np.uint64) ** np.uint64(3)).sum() + np.uint64(len(ints))], np.uint64)).view(np.int64)[0])
                    rows.append((name, ints.tobytes(), len(ints), [{"key": k, "place": p} for k, p in zip(key.view(np.int64).tolist(), place.tolist())]))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.binary(), pa.int64(), kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in keys), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keys, "class", "ints", "n_frames", "landmarks"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recordings.schema if f.name in keys)
    return recordings.select(*keys, column).mapInArrow(run, f"{types}, class bigint, ints binary, n_frames bigint, landmarks array<struct<key:bigint,place:int>>")


def aligned(recordings: DataFrame, column: str = "sound", frames=chroma_of_bytes, most_errors: float = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """A row for each recording: its key columns, class_id (equal fingerprints share one), n_frames, group_id (the least class_id that
    alignments lead to), n_links (alignments found of its class), and the best one: match_id (a class_id), offset (where this recording's
    class begins in the match), overlap and bit_error; null without one.

    recordings: key columns (those named in ADDED are dropped) and column (text or binary; frames turns its bytes into pitch-class frames). All
    classes that share a key are aligned with each other, at the offset with most votes of those that pass. Null and empty sound, and
    recordings shorter than a window, have no frames: each such class stands alone, and all of them are one class. An empty table gives no rows.
    """
    recordings = recordings.drop(*(c for c in ADDED if c != column))
    keys = [c for c in recordings.columns if c != column]
    rows = written(fingerprinted(recordings, column, frames), "fingerprints")
    classes = written(rows.where("n_frames > 0").dropDuplicates(["class"]).select("class", "ints", "landmarks"), "sound-classes")
    marks = classes.select("class", F.explode("landmarks").alias("m")).select("class", F.col("m.key").alias("key"), F.col("m.place").alias("place"))
    # All classes of a key are paired; a hot key's marks are dealt to as many tasks as they need, each against all of them.
    parts = F.ceil(F.col("n") / F.lit(MARKS_A_PART)).cast("int")
    heads = marks.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", parts.alias("parts"))
    shared = written(marks.join(heads.hint("shuffle_hash"), "key"), "sound-marks")
    left = shared.select("key", F.col("class").alias("a"), F.col("place").alias("at"), F.pmod(F.xxhash64("class", "place"), F.col("parts")).cast("int").alias("part"))
    right = shared.select("key", F.col("class").alias("b"), "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    votes = left.join(right, ["key", "part"]).where("a < b").groupBy("a", "b", (F.col("at") - F.col("place")).alias("offset")).agg(F.count("*").alias("votes"))
    # A pair's offsets, most votes first: the first that aligns is taken.
    ordered = F.sort_array(F.collect_list(F.struct("votes", -F.abs("offset"), "offset")), asc=False)
    peaks = votes.groupBy("a", "b").agg(ordered.getField("offset").alias("offsets"))
    both = peaks.join(classes.select(F.col("class").alias("a"), F.col("ints").alias("ints_a")), "a").join(classes.select(F.col("class").alias("b"), F.col("ints").alias("ints_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("offset", pa.int32()), ("overlap", pa.int64()), ("bit_error", pa.float64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, got = [], []
            for i, (a, b, offsets) in enumerate(zip(batch.column("ints_a"), batch.column("ints_b"), batch.column("offsets").to_pylist())):
                a, b = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)
                for at in offsets:
                    n, errors = bit_errors(a, b, at)
                    if n >= least_overlap and errors <= most_errors:
                        good.append(i)
                        got.append((at, n, errors))
                        break
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("a", "b")), *(pa.array([g[k] for g in got], schema.field(k + 2).type) for k in range(3))], schema=schema)

    links = written(both.select("a", "b", "offsets", "ints_a", "ints_b").mapInArrow(verify, "a bigint, b bigint, offset int, overlap bigint, bit_error double"), "alignments")
    groups = components(links).select(F.col("node").alias("class"), F.col("label").alias("group_id"))
    sides = links.select(F.col("b").alias("class"), F.col("a").alias("match_id"), "offset", "overlap", "bit_error").unionByName(links.select(F.col("a").alias("class"), F.col("b").alias("match_id"), (-F.col("offset")).alias("offset"), "overlap", "bit_error"))
    best = sides.groupBy("class").agg(F.count("*").alias("n_links"), F.max(F.struct("overlap", -F.col("bit_error"), "match_id", "offset", "bit_error")).alias("x"))
    best = written(best.join(groups, "class"), "sound-best")
    out = rows.select(*keys, "n_frames", F.when(F.col("n_frames") > 0, F.col("class")).alias("class")).join(best, "class", "left")
    return out.select(*keys, F.coalesce("class", F.lit(0)).alias("class_id"), "n_frames", F.coalesce("group_id", "class", F.lit(0)).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "x.match_id", F.col("x.offset").alias("offset"), F.col("x.overlap").alias("overlap"), F.round("x.bit_error", 6).alias("bit_error"))
