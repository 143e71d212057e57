"""Helpers the training-data operators share: scratch tables, bounded blocks of texts, vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dropped, forget, scratch_tables, shared_dir, written

__all__ = ["dropped", "scratch_tables", "shared_dir", "written"]

#: Texts are handled in blocks of at most so many bytes (one longer text makes a block of its own).
BLOCK_BYTES = 1 << 20


def released(tables: list[tuple[SparkSession, str]], docs: DataFrame) -> None:
    """Deletes those of tables (as scratch_tables() lists them) that docs doesn't read."""
    read = docs.inputFiles() if tables else []
    for t in tables:
        name = t[1].rsplit("/", 1)[-1]  # unique
        if t in scratch_tables() and not any(f"/{name}/" in f for f in read):
            forget(t)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def raw_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary column and its offsets (nulls: empty), without copying a string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most so many bytes together; a longer text comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK_BYTES + 1024)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if m > 4 * BLOCK_BYTES:  # for one very long text: not kept
            return out[0][:n], out[1][:n]
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


#: A random number for each byte, the same in every process.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes[i] * base**i, with a leading 0."""
    p, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * p, out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) that don't depend on where the range lies."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


def lane_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), eight bytes after the other through a bijective mixer: up to eight bytes no two ranges of a length hash alike, and no structure of a longer one cancels out."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    left = end - start
    out = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), start
    while len(live):
        shift = np.minimum(left[live], 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(shift == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (shift % np.uint64(64))) - np.uint64(1))
        out[live] = mix((out[live] ^ (lanes[at] & mask)) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(0x2545F4914F6CDD1D))
        more = left[live] > 8
        live, at = live[more], at[more] + 8
        left[live] -= 8
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts, A-Z lower-cased (if lower): start, end (bytes), hash, and the first word's index of each text (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_space[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, lane_hashes(_lower[data] if lower else data, start, end), np.searchsorted(start, offsets)


def text_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() of texts of any length: a text beyond a block is cut between words, so what is kept of it is 24 bytes a word."""
    if len(offsets) != 2 or len(data) <= 2 * BLOCK_BYTES:
        return words(data, offsets, lower)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        while end < len(data) and not (blank := _space[data[end : end + BLOCK_BYTES]]).any():
            end = min(len(data), end + BLOCK_BYTES)
        end += int(np.argmax(blank)) if end < len(data) else 0
        start, stop, h, _ = words(data[at:end], np.array([0, end - at]), lower)
        parts.append((start + at, stop + at, h))
        at = end
    start, stop, h = (np.concatenate(x) for x in zip(*parts))
    return start, stop, h, np.array([0, len(start)])


_K = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25)]


def mask_hashes(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at the places of mask, for each place where the mask fits: mask (0, 1, 2, 3) gives 4-word shingles."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, at in enumerate(mask):
        total += hashes[at : at + n] * (_K[i % len(_K)] + np.uint64(2 * (i // len(_K))))
    return mix(total)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] numbers), then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)
