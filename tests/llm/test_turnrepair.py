import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from riskloom.llm import turnrepair
from riskloom.llm.turnrepair import PAIRS, START, SYSTEM, USER, Repairs, damaged, illegal, judged, repaired_turns, report

COSTS = (1, 2, 5, 5)
WORDS = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired turns) of (role, text, fault): the first end of a search by cost, then audit string."""
    legal = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIRS}, PAIRS: {"u": USER}}
    heap, done = [(0, "", 0, START, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in (START, PAIRS):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in legal[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, legal[state][role[0]], (*out, (role, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault else 0
            if role[:1] in legal[state]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, legal[state][role[0]], (*out, (role, text))))
            for new in ("user", "assistant"):
                if new[0] in legal[state]:
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, legal[state][new[0]], (*out, (new, text))))


def plain_report(ids, rows):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text in own:
            solid = WORDS.findall(text)
            turns.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
            seen.add((role, text))
        at = {r[1] for r in own} - {None}
        cost, audit, lines = cheapest(turns)
        initials = [r[2][:1] for r in own]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
        n = [sum(f == x for *_, f in turns) for x in ("blank", "duplicate", "truncated")]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(at) - min(at) + 1 - len(at) if at else 0, *n, bad, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def conversations(seed, n, turns):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "and then", "  ", "", None, "Why?\n", "é. ", "a.b"]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, turns)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            role = rng.choice(["system", "tool", "", None, "unknown"]) if rng.random() < 0.15 else role
            text = rng.choice(said) if rng.random() < 0.4 else f"say {rng.randrange(10**6)}" + rng.choice(".!?,")
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 2]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int").repartition(4)


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_every_repair_of_short_conversations_is_the_least(spark):
    """All macro edits of up to four turns, tried one by one."""
    dp = Repairs(*COSTS)
    kinds = [i + f for i in (0, 1, 2, 3) for f in (0, 4, 8)]
    rng = random.Random(1)
    cases = [list(c) for n in range(3) for c in itertools.product(kinds, repeat=n)] + [[rng.choice(kinds) for _ in range(n)] for n in (3, 4) for _ in range(12)]
    names = ["system", "user", "assistant", "tool"]
    for case in cases:
        turns = [(names[k & 3], f"t{i}", "truncated" if k & 4 else "blank" if k & 8 else None) for i, k in enumerate(case)]
        best = None
        for codes in itertools.product(dp.codes, repeat=len(case)):
            for last in range(3):
                audit, cost, states = "".join(codes) + "I" * last, 0, {("", 0)}
                t = 0
                for e in audit:
                    k = case[t] if e != "I" else None
                    if e == "I":
                        states, cost = {(s + r, 0) for s, _ in states for r in "ua"}, cost + 5
                        continue
                    t += 1
                    if e == "D":
                        cost += 2
                    elif k & 8:
                        states = set()
                    else:
                        cost += (5 if k & 4 else 0) + (e == "R")
                        states = {(s + r, 0) for s, _ in states for r in (names[k & 3][0] if e == "K" else "ua")}
                if any(re.fullmatch("(s?(ua)+)?", s) for s, _ in states) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert cheapest(turns)[:2] == best
        layer, cost, parents = dp.run(case, dp.first(START))
        end, last, more = dp.ended(layer)
        assert (cost + more, "".join(dp.edits(parents, end)) + "I" * last) == best


@pytest.mark.parametrize("most_turns", [turnrepair.CHUNK_TURNS, 3, 1])
def test_equal_to_plain_search(spark, most_turns):
    rows = conversations(2, 60, 14) + [(None, 0, "user", "Hi."), (None, None, None, None), (None, 1, "assistant", "Ho.")]
    rows += [(100, i, ("user", "assistant")[i % 2], f"long {i % 90}.") for i in range(400)] + [(101, 5, "user", "Same.")] * 50 + [(102, None, "system", "One.")]
    drops = next(c for c in range(200, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((drops, 0, "user", "Gone."))
    ids = {r[0] for r in rows}
    want = plain_report(ids, plain_damage(rows))
    assert want[drops] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    hurt = damaged(table(spark, rows))
    assert got(report(hurt, most_turns=most_turns)) == want
    lines = {}
    for r in repaired_turns(hurt, most_turns=most_turns).orderBy("conv_id", "chunk", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in ids} == {c: w[-1] for c, w in want.items()}


def test_undamaged_long_texts_and_no_rows(spark):
    rows = [(1, 0, "user", "x" * 1_500_000 + "."), (1, 1, "assistant", "y" * 1_200_000), (1, 2, "assistant", "Fine."), (2, 0, "assistant", "Hello.")]
    assert got(report(table(spark, rows))) == plain_report({1, 2}, rows)
    assert report(table(spark, rows).limit(0)).collect() == [] and repaired_turns(table(spark, rows).limit(0)).collect() == []


def test_layers_stay_few():
    dp, rng = Repairs(*COSTS), random.Random(3)
    for _ in range(40):
        dp.run([rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 10]) for _ in range(3000)], dp.first(START))
    assert len({layer for layer, _ in dp.after}) < 400


def test_faults_and_neighbours():
    kinds, n = judged(["user", "user", "assistant", "tool"], ["a.", "a.", " \t", "b"])
    assert kinds == [1, 9, 10, 7] and n == {"blank": 1, "duplicate": 1, "truncated": 1}
    assert illegal(["s", "u", "a", "u", "u", ""]) == 2
    with pytest.raises(ValueError):
        Repairs(insert=0)
