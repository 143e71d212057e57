"""Conversation structure repair: a rank-compressed dynamic program over turns.

A repaired conversation's role initials match (s?(ua)+)?. The states of a conversation under repair are 0 (nothing yet), 1 (a system turn), 2
(a user turn, an assistant's is due) and 3 (whole pairs); 0 and 3 may end. Each turn is taken by one macro edit: a run of inserts
and then what becomes of the turn, written I...ID, I...IK or I...IR. No such code begins another one, and they are ordered as strings;
so the audit strings of two partial repairs of the same turns never begin one another, and compare as the ranks of what came before and
then as the codes. A layer therefore holds nothing but a cost and a rank for each state, and a parent pointer (state and code) for each turn; the audit
string is read off the pointers afterwards. A layer less its least cost is one of a few dozen, so steps are looked up.

Layers compose: what a stretch of turns makes of each state it may begin in (cost and rank of each state it may end in) is all that its
neighbours need. Turns are dealt by ranges of (conversation, turn), so that a conversation of any size lies in any number of tasks, and
packed into chunks of bounded rows and bytes. Most conversations are one chunk and are finished where they lie. For the others chunks are
summed up, the summaries are strung together, and each chunk is repaired between the states that it was given; only the hash
of the repaired text, which has no parallel form, reads a conversation's chunks in one stream.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, PAIRS = range(4)
ROLES = {USER: "user", PAIRS: "assistant"}
#: A chunk ends after so many turns or bytes of text (one longer text makes it longer); conversations of several chunks that are broadcast at most.
CHUNK_TURNS, CHUNK_BYTES, MAX_BROADCAST = 4096, 1 << 20, 1_000_000
#: Characters of a text that order turns of one conversation, turn and role; hashes do beyond.
ORDER_CHARS = 1000

INITIALS = {"s": 0, "u": 1, "a": 2}
UNFINISHED, GONE = 4, 8  # added to an initial's number: what kind of turn it is


class Repairs:
    """The dynamic program for given costs; an insert must cost something."""

    def __init__(self, rerole: int = 1, delete: int = 2, insert: int = 5, unfinished: int = 5):
        if insert <= 0 or min(rerole, delete, unfinished) < 0:
            raise ValueError("an insert must cost something, and nothing less than 0")
        self.insert, self.slack = insert, max(2 * insert, insert + delete)
        self.codes = sorted("I" * n + edit for n in range(3) for edit in "DKR")
        runs = {}  # state -> states that so many inserts lead to
        for x in range(4):
            runs[x] = [x, USER if x != USER else PAIRS, PAIRS if x != USER else USER]
        self.moves = {}  # kind, state -> (next state, cost, code)
        for kind in [i + f for i in range(4) for f in (0, UNFINISHED, GONE)]:
            initial, extra = kind & 3, unfinished if kind & UNFINISHED else 0
            for x in range(4):
                found = []
                for n, y in enumerate(runs[x]):
                    due = PAIRS if y == USER else USER
                    edits = [("D", y, delete)]
                    if not kind & GONE:
                        edits.append(("R", due, rerole + extra))
                        if initial == 0 and y == START:
                            edits.append(("K", SYSTEM, extra))
                        elif initial == due - 1:  # u when a user is due, a when an assistant is
                            edits.append(("K", due, extra))
                    found += [(to, n * insert + cost, self.codes.index("I" * n + e)) for e, to, cost in edits]
                self.moves[kind, x] = found
        self.after = {}  # layer, kind -> layer, cost, parents

    @staticmethod
    def first(state: int) -> tuple:
        """The layer of a stretch that begins in the state."""
        return tuple((0, 0) if x == state else None for x in range(4))

    def _settled(self, best: dict) -> tuple:
        """The layer of {state: (cost, *order, pointer)}, its least cost and pointers; states that can't pay off any more are left out."""
        least = min(b[0] for b in best.values())
        best = {t: b for t, b in best.items() if b[0] <= least + self.slack}
        ranks = {o: i for i, o in enumerate(sorted({b[1:3] for b in best.values()}))}
        layer = tuple((best[t][0] - least, ranks[best[t][1:3]]) if t in best else None for t in range(4))
        return layer, least, tuple(best[t][3] if t in best else None for t in range(4))

    def step(self, layer: tuple, kind: int) -> tuple:
        """The next layer, what its least cost is above this one's, and the parents: for each state (state before, code)."""
        got = self.after.get((layer, kind))
        if got is None:
            best: dict = {}
            for x, held in enumerate(layer):
                if held:
                    for to, cost, code in self.moves[kind, x]:
                        new = (held[0] + cost, held[1], code, (x, code))
                        if to not in best or new < best[to]:
                            best[to] = new
            got = self.after[layer, kind] = self._settled(best)
        return got

    def run(self, kinds: list[int], layer: tuple) -> tuple[tuple, int, list]:
        """The layer after turns of these kinds, its least cost, and the parents of each turn."""
        total, parents = 0, []
        for kind in kinds:
            layer, cost, back = self.step(layer, kind)
            total += cost
            parents.append(back)
        return layer, total, parents

    def joined(self, layer: tuple, stretches: dict[int, tuple[tuple, int]]) -> tuple[tuple, int, tuple]:
        """step() over a stretch: stretches has, for each state it may begin in, the layer at its end and its least cost. The parents are states."""
        best: dict = {}
        for x, held in enumerate(layer):
            if held:
                end, cost = stretches[x]
                for t, e in enumerate(end):
                    if e:
                        new = (held[0] + cost + e[0], held[1], e[1], x)
                        if t not in best or new < best[t]:
                            best[t] = new
        return self._settled(best)

    def ended(self, layer: tuple) -> tuple[int, int, int]:
        """The state to end in, the inserts that come last, and the cost above the layer's least."""
        last = {START: 0, SYSTEM: 2, USER: 1, PAIRS: 0}
        cost, _, x = min((held[0] + self.insert * last[x], held[1], x) for x, held in enumerate(layer) if held)
        return x, last[x], cost

    def edits(self, parents: list, end: int) -> list[str]:
        """The macro edit of each turn of a stretch that ends in the state."""
        out = []
        for back in reversed(parents):
            end, code = back[end]
            out.append(self.codes[code])
        return out[::-1]


@functools.cache
def repairs(*costs: int) -> Repairs:
    return Repairs(*costs)


def repaired(edits: list[str], state: int, roles: list[str], texts: list[str], last: int = 0) -> tuple[str, list[str], list[str]]:
    """The audit string, the roles and the texts that edits make of turns, beginning in the state; last inserts follow."""
    out_roles, out_texts = [], []
    for edit, role, text in zip([*edits, "I" * last], [*roles, ""], [*texts, ""]):
        for e in edit:
            due = PAIRS if state == USER else USER
            if e == "D":
                continue
            state = SYSTEM if e == "K" and role[:1] == "s" else due
            out_roles.append(role if e == "K" else ROLES[state])
            out_texts.append("" if e == "I" else text)
    return "".join(edits) + "I" * last, out_roles, out_texts


def judged(roles: list[str], texts: list[str], again: set[int] | None = None) -> tuple[list[int], dict[str, int]]:
    """The kind of each turn, and how many are blank, duplicate and truncated; again: turns that an earlier one equals (None: look for them here)."""
    if again is None:
        seen, again = set(), set()
        for i, turn in enumerate(zip(roles, texts)):
            again.add(i) if turn in seen else seen.add(turn)
    kinds, n = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for i, (role, text) in enumerate(zip(roles, texts)):
        kind, solid = INITIALS.get(role[:1], 3), text.rstrip(BLANKS)
        fault = "blank" if not solid else "duplicate" if i in again else "truncated" if solid[-1] not in ".!?" else None
        if fault:
            n[fault] += 1
            kind += UNFINISHED if fault == "truncated" else GONE
        kinds.append(kind)
    return kinds, n


def illegal(initials: list[str]) -> int:
    """Neighbours among role initials that don't follow each other in a repaired conversation."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text; nulls count as one space) with planted faults, decided by crc32(conv_id:turn) % 20: 0 drops a row (it stays as `dropped`),
    1 empties its text, 2 takes out .!?, 3 repeats it, 4 makes its role user. Each row is judged on its own, repeated ones too."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), what.alias("what"))
    rows = rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "what")
    return rows.select("conv_id", "turn", "role", "text", (F.col("what") == 0).alias("dropped"), F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


CHUNK = pa.schema([("conv", pa.int64()), ("void", pa.bool_()), ("chunk", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
CHUNK_SQL = "conv bigint, void boolean, chunk bigint, turns array<bigint>, roles array<string>, texts array<string>"
KEY = ["conv", "void", "chunk"]


def chunks(rows: DataFrame, most_turns: int = CHUNK_TURNS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The turns of each conversation in order, packed: conv and void (conv_id, or that it is null), chunk (rising along a conversation), turns, roles, texts.

    A conversation whose rows are all dropped has an empty chunk.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    live = ~F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(True)
    conv = F.col("conv_id").cast("bigint")
    rows = rows.select(F.coalesce(conv, F.lit(0)).alias("conv"), conv.isNull().alias("void"), live.alias("live"), F.when(live, F.col("turn").cast("bigint")).alias("turn"), F.when(live, text("role")).otherwise("").alias("role"), F.when(live, text("text")).otherwise("").alias("text"))
    # Equal rows differ by their number alone, so that any number of them is dealt to several tasks.
    order = [F.col("conv"), F.col("void"), F.col("turn"), F.col("role"), F.substring("text", 1, ORDER_CHARS), F.xxhash64("text"), F.col("number")]
    rows = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, out, out_size = None, None, 0, [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "void", "live", "turn", "role", "text", "place"))
            for conv, void, live, turn, role, text, place in zip(*columns):
                if key != (conv, void) or len(held["turns"]) >= most_turns or size >= most_bytes:
                    if held:
                        out.append(held)
                        out_size += size + 200
                    key, held, size = (conv, void), {"conv": conv, "void": void, "chunk": place, "turns": [], "roles": [], "texts": []}, 0
                    if out_size >= 4 * most_bytes:
                        yield pa.RecordBatch.from_pylist(out, CHUNK)
                        out, out_size = [], 0
                if live:
                    held["turns"].append(turn)
                    held["roles"].append(role)
                    held["texts"].append(text)
                    size += len(text) + 16
        if held:
            yield pa.RecordBatch.from_pylist([*out, held], CHUNK)

    return rows.drop("number").withColumn("place", F.monotonically_increasing_id()).mapInArrow(run, CHUNK_SQL)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = pa.schema([("conv", pa.int64()), ("void", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
REPORT_SQL = "conv bigint, void boolean, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string"
HASHED = pa.schema([*list(REPORT)[:-2], ("repaired_sha256", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch], f, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """f of each row, in small batches."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            yield pa.RecordBatch.from_pylist([f(r) for r in batch.slice(lo, 64).to_pylist()], schema)


def joined_lines(roles: list[str], texts: list[str]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()


def whole(row: dict, costs: tuple[int, ...]) -> dict:
    """The report and the repaired turns of a conversation in one chunk."""
    dp, roles, texts = repairs(*costs), row["roles"], row["texts"]
    kinds, n = judged(roles, texts)
    layer, cost, parents = dp.run(kinds, dp.first(START))
    end, last, more = dp.ended(layer)
    audit, roles_, texts_ = repaired(dp.edits(parents, end), START, roles, texts, last)
    turns = {t for t in row["turns"] if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return {"conv": row["conv"], "void": row["void"], "gaps": gaps, **n, "illegal": illegal([r[:1] for r in roles]), "cost": cost + more, "audit": audit, "roles": roles_, "texts": texts_}


def summary(row: dict, costs: tuple[int, ...]) -> dict:
    """What the other chunks need of one: layers for each state it may begin in, faults, and both ends."""
    dp = repairs(*costs)
    kinds, n = judged(row["roles"], row["texts"], set(row["again"] or ()))
    layers = []
    for x in range(4):
        layer, cost, _ = dp.run(kinds, dp.first(x))
        layers += [cost, *(v for held in layer for v in (held or (-1, -1)))]
    initials, turns = [r[:1] for r in row["roles"]], sorted({t for t in row["turns"] if t is not None})
    return {"conv": row["conv"], "void": row["void"], "chunk": row["chunk"], "layers": layers, **n, "illegal": illegal(initials), "head": initials[0] if initials else None, "tail": initials[-1] if initials else None, "n_turns": len(turns), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}


SUMMARY = pa.schema([("conv", pa.int64()), ("void", pa.bool_()), ("chunk", pa.int64()), ("layers", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("head", pa.string()), ("tail", pa.string()), *((c, pa.int64()) for c in ("n_turns", "low", "high"))])
SUMMARY_SQL = "conv bigint, void boolean, chunk bigint, layers array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, n_turns bigint, low bigint, high bigint"
#: Of each chunk: the states it begins and ends in, and the inserts after it; with a conversation's last chunk its counts.
PLACED = pa.schema([("conv", pa.int64()), ("void", pa.bool_()), ("chunk", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("last", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
PLACED_SQL = "conv bigint, void boolean, chunk bigint, begin bigint, `end` bigint, last bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def strung(parts: list[dict], costs: tuple[int, ...]) -> list[dict]:
    """The rows of PLACED for a conversation's summaries, in order."""
    dp = repairs(*costs)
    layer, total, parents = dp.first(START), 0, []
    n = dict.fromkeys(COUNTS, 0)
    tail = low = high = None
    turns = 0
    for p in parts:
        v = p["layers"]
        stretches = {x: (tuple((v[i], v[i + 1]) if v[i] >= 0 else None for i in range(9 * x + 1, 9 * x + 9, 2)), v[9 * x]) for x in range(4)}
        layer, cost, back = dp.joined(layer, stretches)
        total += cost
        parents.append(back)
        for c in ("blank", "duplicate", "truncated", "illegal"):
            n[c] += p[c]
        if p["head"] is not None:
            n["illegal"] += illegal([tail, p["head"]]) if tail is not None else 0
            tail = p["tail"]
        if p["n_turns"]:
            turns += p["n_turns"] - (p["low"] == high)
            low, high = p["low"] if low is None else low, p["high"]
    state, last, more = dp.ended(layer)
    n["gaps"], n["cost"] = high - low + 1 - turns if turns else 0, total + more
    out = []
    for p, back in zip(reversed(parts), reversed(parents)):
        out.append({"conv": p["conv"], "void": p["void"], "chunk": p["chunk"], "begin": back[state], "end": state, "last": 0 if out else last, **(n if not out else {})})
        state = back[state]
    return out[::-1]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation, which come one after the other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["conv"], held[0]["void"]) != (row["conv"], row["void"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _of_several(packed: DataFrame, costs: tuple[int, ...]) -> DataFrame:
    """Of conversations in several chunks, each chunk as PLACED says, with audit, roles and texts as repaired."""
    turns = packed.select(*KEY, F.posexplode(F.arrays_zip("roles", "texts"))).select(*KEY, "pos", F.col("col.roles").alias("role"), F.sha2(F.col("col.texts"), 256).alias("hash"))
    same = ["conv", "void", "role", "hash"]
    firsts = turns.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("chunk", "pos")).alias("first")).where("n > 1").drop("n")
    again = turns.join(firsts, same).where(F.struct("chunk", "pos") > F.col("first")).groupBy(*KEY).agg(F.collect_list("pos").alias("again"))  # a chunk has CHUNK_TURNS turns at most
    known = written(packed.join(again, KEY, "left"), "turns-known")
    sums = known.mapInArrow(lambda batches: _rows(batches, lambda r: summary(r, costs), SUMMARY), SUMMARY_SQL)

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches):
            yield pa.RecordBatch.from_pylist(strung(parts, costs), PLACED)

    placed = sums.repartition("conv", "void").sortWithinPartitions(*KEY).mapInArrow(string, PLACED_SQL)
    schema = pa.schema([*PLACED, ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def rebuilt(row: dict) -> dict:
        dp = repairs(*costs)
        kinds, _ = judged(row["roles"], row["texts"], set(row["again"] or ()))
        _, _, parents = dp.run(kinds, dp.first(row["begin"]))
        audit, roles, texts = repaired(dp.edits(parents, row["end"]), row["begin"], row["roles"], row["texts"], row["last"])
        return {**{c: row[c] for c in PLACED.names}, "audit": audit, "roles": roles, "texts": texts}

    return known.join(placed, KEY).mapInArrow(lambda batches: _rows(batches, rebuilt, schema), PLACED_SQL + ", audit string, roles array<string>, texts array<string>")


def _split(rows: DataFrame, most_turns: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The chunks of conversations that are one chunk, and of the others (None if there are none)."""
    packed = written(chunks(rows, most_turns, most_bytes), "turns")
    several = written(packed.groupBy("conv", "void").count().where("count > 1").select("conv", "void"), "turns-several")
    n = several.count()
    if not n:
        return packed, None
    several = F.broadcast(several) if n <= MAX_BROADCAST else several
    return packed.join(several, ["conv", "void"], "left_anti"), packed.join(several, ["conv", "void"], "left_semi")


def _named(t: DataFrame) -> DataFrame:
    return t.select(F.when(~F.col("void"), F.col("conv")).alias("conv_id"), *(c for c in t.columns if c not in ("conv", "void")))


def report(rows: DataFrame, costs: tuple[int, ...] = (1, 2, 5, 5), most_turns: int = CHUNK_TURNS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text; maybe dropped; more columns are ignored): its faults and its cheapest repair.

    costs: of a new role, a deletion, an insert, and of leaving a truncated turn. Turns are ordered by turn (nulls first), role and text (its first
    ORDER_CHARS characters, then a hash). Null roles and texts are one space; a conversation without id is one of its own. A turn's first fault
    counts: blank, duplicate (role and text stood before), truncated (its last solid character is none of .!?). Blank and duplicate turns
    must go. A role goes by its first letter; one that begins with none of s, u and a can't be kept. Returns conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit (the edits' initials; the ASCII-least of cheapest ones) and repaired_sha256 (role:text by lines). Rows that are
    dropped name their conversation only; one without others has zeros, no audit and the hash of nothing. Conversations and texts may have any
    length; rows that repeat are duplicates. An empty table gives no rows.
    """
    one, several = _split(rows, most_turns, most_bytes)

    def finish(row: dict) -> dict:
        r = whole(row, costs)
        return {**{c: r[c] for c in HASHED.names[:-1]}, "repaired_sha256": hashlib.sha256(joined_lines(r["roles"], r["texts"])).hexdigest()}

    out = one.mapInArrow(lambda batches: _rows(batches, finish, HASHED), REPORT_SQL + ", repaired_sha256 string")
    if several is not None:

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = None
            for batch in batches:
                for lo in range(0, batch.num_rows, 16):
                    for row in batch.slice(lo, 16).to_pylist():
                        if key != (row["conv"], row["void"]):
                            key, digest, audit, lines = (row["conv"], row["void"]), hashlib.sha256(), [], 0
                        audit.append(row["audit"])
                        if row["roles"]:
                            digest.update((b"\n" if lines else b"") + joined_lines(row["roles"], row["texts"]))
                            lines += len(row["roles"])
                        if row["cost"] is not None:  # the last chunk
                            yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("conv", "void", *COUNTS)}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], HASHED)

        pieces = _of_several(several, costs).repartition("conv", "void").sortWithinPartitions(*KEY)
        out = out.unionByName(pieces.mapInArrow(hashed, REPORT_SQL + ", repaired_sha256 string"))
    return _named(out)


def repaired_turns(rows: DataFrame, costs: tuple[int, ...] = (1, 2, 5, 5), most_turns: int = CHUNK_TURNS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The repaired conversations themselves, see report(): conv_id, chunk and place (in order), role, text."""
    one, several = _split(rows, most_turns, most_bytes)
    schema, sql = pa.schema([("conv", pa.int64()), ("void", pa.bool_()), ("chunk", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]), "conv bigint, void boolean, chunk bigint, roles array<string>, texts array<string>"

    def finish(row: dict) -> dict:
        r = whole(row, costs)
        return {"chunk": row["chunk"], **{c: r[c] for c in ("conv", "void", "roles", "texts")}}

    out = one.mapInArrow(lambda batches: _rows(batches, finish, schema), sql)
    if several is not None:
        out = out.unionByName(_of_several(several, costs).select(*schema.names))
    out = out.select("conv", "void", "chunk", F.posexplode(F.arrays_zip("roles", "texts")))
    return _named(out.select("conv", "void", "chunk", F.col("pos").alias("place"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text")))
