"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' ids, one after another. Round-robin serves the queues in quanta of `grain`
ids; a queue earns credit in proportion to its weight and sends a quantum as soon as its credit covers one, so that what
it is owed (its deficit, under one quantum) goes over to the next window, and to the next partition. A quantum k of queue q is
therefore due at the virtual time (k + 1) / weight[q], and the ids served before it are counted for all queues at once
in integers: any partition knows the state that the one before it leaves, and places its own rows without a
shuffle of ids. A queue that runs dry drops out, and the others go on in their proportions.

The stream of ids is cut at multiples of the window, so only its tail could need padding; that is cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, raw_strings, spread, written

WINDOW, GRAIN, MAX_QUEUES, WEIGHT_UNITS = 1024, 64, 256, 1_000_000
#: A broadcast row takes under 40 bytes: 16 MB at most.
MAX_BROADCAST_ROWS = 400_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"


class Schedule:
    """Where each id of each queue goes: integers alone, the same in every task."""

    def __init__(self, totals: list[int], weights: list[int], grain: int, window: int):
        self.totals, self.weights, self.grain, self.window = totals, weights, grain, window
        self.total = sum(totals)
        full, rest = divmod(self.total, window)
        tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full, self.tail = full, full * window + np.cumsum([0, *tail])

    def served(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Ids that all queues have sent before quantum k of queue."""
        own = np.asarray(self.weights, np.int64)[queue]
        out = np.zeros(len(k), np.int64)
        for q, (total, weight) in enumerate(zip(self.totals, self.weights)):
            due = (k + 1) * weight
            n = np.where(queue == q, k, np.where(queue > q, due // own, (due - 1) // own))  # ties: the lower queue first
            out += np.minimum(total, n * self.grain)
        return out

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of places in the stream: the sequence, its first place and its end."""
        seq, tail = at // self.window, at >= self.tail[0]
        first, end = seq * self.window, (seq + 1) * self.window
        if tail.any():
            t = np.searchsorted(self.tail, at[tail], side="right") - 1
            seq[tail], first[tail], end[tail] = self.full + t, self.tail[t], self.tail[np.minimum(t + 1, len(self.tail) - 1)]
        return seq, first, end

    def pieces(self, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Of documents at begin of their queues with n ids each: the pieces, in order."""
        g = self.grain
        k0, k1 = begin // g, (begin + n - 1) // g
        row = np.repeat(np.arange(len(n)), k1 - k0 + 1)
        k = spread(k0, k1 - k0 + 1)
        lo, hi = np.maximum(k * g, begin[row]), np.minimum((k + 1) * g, (begin + n)[row])
        at = self.served(queue[row], k) + lo - k * g
        while True:  # cut at the ends of sequences
            _, _, end = self.sequence(at)
            over = at + (hi - lo) > end
            if not over.any():
                break
            cut = lo + (end - at)
            row, at = np.concatenate([row, row[over]]), np.concatenate([at, end[over]])
            lo, hi = np.concatenate([lo, cut[over]]), np.concatenate([np.where(over, cut, hi), hi[over]])
            order = np.lexsort((lo, row))
            row, at, lo, hi = row[order], at[order], lo[order], hi[order]
        seq, first, _ = self.sequence(at)
        new = np.ones(len(row), bool)  # join what lies side by side
        if len(row) > 1:
            new[1:] = (row[1:] != row[:-1]) | (seq[1:] != seq[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1])
        heads = np.flatnonzero(new)
        lasts = np.append(heads[1:], len(row)) - 1
        row, lo = row[heads], lo[heads]
        return {"row": row, "start": lo - begin[row], "length": hi[lasts] - lo, "sequence_id": seq[heads], "offset": at[heads] - first[heads]}


def tokenised(docs: DataFrame, tokenizer: str, queues: list[str | None]) -> DataFrame:
    """Per document: its queue, its ids and where they start among the ids of its part and queue."""
    names = {s: i for i, s in enumerate(queues)}
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("queue", pa.int32()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder_of

        part, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder_of(tokenizer)
            _, offsets = raw_strings(batch.column("text"))
            for lo, hi in blocks(offsets, 1 << 20):
                piece = batch.slice(lo, hi - lo)
                ids, counts = encoder.encode(["" if x is None else x for x in piece.column("text").to_pylist()])
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                sources = piece.column("source").to_pylist()
                queue = [names.get(s, len(queues)) for s in sources]
                local = []
                for q, c in zip(queue, counts.tolist()):
                    local.append(sent.get(q, 0))
                    sent[q] = local[-1] + c
                rows = [data[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(sources, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(queue, pa.int32()), pa.array(local, pa.int64()), pa.array(counts), pa.array(rows, pa.binary())], schema=schema)

    columns = "doc_id bigint, source string, part int, queue int, local_start bigint, n bigint, ids binary"
    return written(docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, columns), "packing")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, grain: int = GRAIN, max_queues: int = MAX_QUEUES, mixture: dict[str, float] | None = None) -> DataFrame:
    """Packs docs (doc_id, text, source; more columns are ignored) into sequences of at most window ids.

    Returns a row for each piece of a document; see PIECES. A document's ids are those of its text and a final 0.
    Null or empty text gives the one id 0. Rows that repeat are packed each; texts are packed whole, however long. A null source is a queue of its own.
    mixture: the target share of sources, each of which has a queue; what it leaves of 1 goes to the others in proportion to
    their ids (1e-6 of all at least), so without it the targets are the corpus's own shares, and all queues end together. Sources after
    those and the max_queues with most rows share one queue, in whose stream they come in the order of the rows. Ties in time go to the queue with more rows.
    Every id is packed: a mixture orders the stream and drops nothing. An empty table gives no rows.
    """
    if window < 1 or grain < 1 or max_queues < 1:
        raise ValueError("window, grain and max_queues must be positive")
    mixture = mixture or {}
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).count()
    named = F.coalesce(F.col("source").isin(*mixture), F.lit(False)) if mixture else F.lit(False)
    counts = counts.orderBy(named.desc(), F.desc("count"), "source").limit(len(mixture) + max_queues).collect()
    queues = [r["source"] for r in sorted(counts, key=lambda r: -r["count"])]
    rows = tokenised(docs, tokenizer, queues)
    parts = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = [0] * (len(queues) + 1)
    for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # at most max_queues rows
        totals[r["queue"]] = r["n"]
    apart = [s in mixture for s in queues] + [False]
    left, rest = max(0.0, 1 - sum(mixture.values())), sum(t for t, a in zip(totals, apart) if not a) or 1
    shares = [mixture[s] if a else left * t / rest for s, t, a in zip([*queues, None], totals, apart)]
    whole = sum(shares) or 1
    schedule = Schedule(totals, [max(1, round(WEIGHT_UNITS * x / whole)) for x in shares], grain, window)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-base")
    if base.count() <= MAX_BROADCAST_ROWS:  # else Spark joins by a shuffle
        base = F.broadcast(base)
    out = pa.schema([(f, pa.int64()) for f in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = raw_strings(batch.column("ids"))
            for lo, hi in blocks(offsets, 4 << 20):
                b = batch.slice(lo, hi - lo)
                data, at = raw_strings(b.column("ids"))
                n = b.column("n").to_numpy()
                p = schedule.pieces(b.column("queue").to_numpy().astype(np.int64), b.column("base").to_numpy() + b.column("local_start").to_numpy(), n)
                first = at[p["row"]] + 4 * p["start"]
                view, crc = memoryview(data), zlib.crc32
                sums = [crc(view[i:j]) for i, j in zip(first.tolist(), (first + 4 * p["length"]).tolist())]
                take = pa.array(p["row"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), pa.array(p["start"]), pa.array(p["length"]), pa.array(sums, pa.int64()), pa.array(n[p["row"]]), pa.array(p["sequence_id"]), pa.array(p["offset"]), b.column("source").take(take)], schema=out)

    return rows.join(base, ["queue", "part"]).select("doc_id", "source", "queue", "base", "local_start", "n", "ids").mapInArrow(run, PIECES)
