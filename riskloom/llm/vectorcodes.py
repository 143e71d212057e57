"""Vector code compression: product quantisation in integers, with ball trees over each part's entries.

A vector's components become floor(SCALE * x), cut into parts; each part is coded by the nearest entry of its position's codebook. Codebooks
are trained by rounds of assignment and integer means over all vectors: tasks add up their own parts by entry, Spark adds up the
tasks' sums, and the driver holds nothing but the codebooks (parts x entries x components of a part).

A position's entries are in a ball tree: a node has a centre and a radius that covers its entries, and splits them by the two
of them that lie farthest apart. A block of parts goes down the tree together, the nearer child first; a part skips a node if it is farther
from the centre than its best distance so far and the radius together. Distances here are doubles: the radius is rounded up by more
than their error and a node at the very bound is visited, so that no nearest entry, nor an equally near one with a lower number, is
missed. At a leaf squared distances are exact integers, which alone decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components are held within +-2**LIMIT_BITS, so that squared distances of up to 512 components fit a long.
LIMIT_BITS = 26
#: Entries of a leaf at most; vectors that are searched together.
LEAF, BLOCK = 4, 8192
#: Relative error allowed for in a distance of doubles: far above what sums and roots of so few terms can have.
ROUNDING = 1e-9


class BallTree:
    """Nearest entries, lowest number first among equals. entries: integers, a row each, one at least."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries = entries.astype(np.int64)
        self.visits = 0  # parts that were compared with an entry
        self.root = self._node(np.arange(len(entries)), leaf)

    def _node(self, members: np.ndarray, leaf: int) -> dict:
        points = self.entries[members]
        centre = points.astype(np.float64).mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        node = {"centre": centre, "radius": float(away.max()) * (1 + ROUNDING) + ROUNDING, "members": members, "children": ()}
        if len(members) > leaf and (points != points[0]).any():
            one = points[int(np.argmax(away))]
            far = ((points - one) ** 2).sum(axis=1)
            other = points[int(np.argmax(far))]
            near = far <= ((points - other) ** 2).sum(axis=1)
            node["children"] = (self._node(members[near], leaf), self._node(members[~near], leaf))
        return node

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each row of parts, and its squared distance."""
        best = np.full(len(parts), np.iinfo(np.int64).max)
        code = np.zeros(len(parts), np.int64)
        wide = parts.astype(np.float64)

        def visit(node: dict, rows: np.ndarray, away: np.ndarray) -> None:
            reach = np.sqrt(best[rows].astype(np.float64)) * (1 + ROUNDING) + node["radius"]
            open_ = away * (1 - ROUNDING) <= reach
            rows = rows[open_]
            if not len(rows):
                return
            if not node["children"]:
                self.visits += len(rows) * len(node["members"])
                for i in node["members"].tolist():
                    d = ((parts[rows] - self.entries[i]) ** 2).sum(axis=1)
                    better = (d < best[rows]) | ((d == best[rows]) & (i < code[rows]))
                    best[rows[better]], code[rows[better]] = d[better], i
                return
            left, right = node["children"]
            a, b = (np.sqrt(((wide[rows] - c["centre"]) ** 2).sum(axis=1)) for c in (left, right))
            first = a - left["radius"] <= b - right["radius"]
            visit(left, rows[first], a[first])
            visit(right, rows, b)
            visit(left, rows[~first], a[~first])

        visit(self.root, np.arange(len(parts)), np.zeros(len(parts)))
        return code, best


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal ones if size is a multiple of parts."""
    return [(size * i // parts, size * (i + 1) // parts) for i in range(parts)]


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (floor(scale * x) of each component) of the rows whose vector is there and has finite components only."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.alias("label"), x.alias("x"))
    rows = rows.where("x is not null").where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    most = float(1 << LIMIT_BITS)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.greatest(F.least(F.floor(c * scale), F.lit(most)), F.lit(-most)).cast("int")).alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def sums(kept: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """part, entry, n and total (of each component) of the parts nearest to each entry."""
    cuts = bounds(size, len(books))
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("place", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        totals, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                v = _matrix(batch.column("v").slice(at, BLOCK), size)
                for p, (lo, hi) in enumerate(cuts):
                    code, _ = trees[p].nearest(v[:, lo:hi])
                    np.add.at(totals[p], code, v[:, lo:hi])
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
        rows = [(p, e, n, i, t) for p in range(len(books)) for e, n in enumerate(counts[p].tolist()) if n for i, t in enumerate(totals[p][e].tolist() or [0])]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    each = kept.select("v").mapInArrow(run, "part int, entry int, n bigint, place int, total bigint")
    return each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def trained(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position after the rounds; none if kept (see integers()) is empty. It begins with the parts of the first vectors by vec_id (then by components; those without id last)."""
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not first:
        return []
    start = np.array([r["v"] for r in first], np.int64)
    cuts = bounds(start.shape[1], parts)
    books = [start[:, lo:hi].copy() for lo, hi in cuts]
    for _ in range(rounds):
        for r in sums(kept, books, start.shape[1]).collect():  # a row for each component of each entry
            lo, hi = cuts[r["part"]]
            if r["place"] < hi - lo:
                books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and place, decimal and joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def coded(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part; more where a codebook has over 256 entries) and error (the squared distances, summed)."""
    size = sum(b.shape[1] for b in books)
    cuts = bounds(size, len(books)) if books else []
    digits = max(2, len(f"{max((len(b) for b in books), default=1) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = _matrix(part.column("v"), size)
                found = [trees[p].nearest(v[:, lo:hi]) for p, (lo, hi) in enumerate(cuts)]
                codes = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Each usable row of vectors (vec_id, embedding; maybe label; more columns are ignored) as codes: vec_id, code, error, label_error, codebooks_sha256.

    Rows without a vector, or with null or non-finite components, are left out; so are vectors without components or with another number of them than the
    one with the least vec_id has. Components beyond 2**LIMIT_BITS count as that. A vector whose size is no multiple of parts is cut as
    evenly as can be. Codebooks begin with the vectors of the least vec_ids, of all there are if they are fewer (repeated ids and
    vectors count as rows; null ids come last); equally near entries: the lower number. label_error is the sum of error over equal labels, nulls together;
    null if it doesn't fit a long. An empty table gives no rows.
    """
    kept = written(integers(vectors, scale=scale).where("size(v) > 0"), "vectors")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("size")).collect()
    if first:
        kept = kept.where(F.size("v") == first[0]["size"])
    books = trained(kept, parts, entries, rounds)
    rows = written(coded(kept, books), "vector-codes")
    # A row for each label: Spark broadcasts it where it is small and splits hot labels where it isn't.
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
