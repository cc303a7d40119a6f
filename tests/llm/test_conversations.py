"""Repair of conversations against a search of all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from loomwatch.llm import conversations as c

LEGAL_END = (0, 3)


def cheapest(rows):
    """(cost, edits, repaired rows) by a best-first search over (row, state); rows are (role, text, gone, cut)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in LEGAL_END:
            return cost, edits, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        name = "assistant" if state == 2 else "user"
        after = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 3, edits + "I", i, after, (*out, (name, ""))))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, out))
            if not gone:
                heapq.heappush(heap, (cost + 3 + 3 * cut, edits + "R", i + 1, after, (*out, (name, text))))
                if role[:1] == name[0] or (role[:1] == "s" and state == 0):
                    heapq.heappush(heap, (cost + 3 * cut, edits + "K", i + 1, 1 if role[:1] == "s" else after, (*out, (role, text))))


def report(rows):
    """The report of one conversation, its rows (conv, turn, role, text) as in the table."""
    kept = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in kept:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        judged.append((role, text, kind in (0, 1), kind == 2))
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r, *_ in judged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, edits, out = cheapest(judged)
    return (gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, slice string, block int")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in c.repair_report(df, **more).collect()}


def made(rng, conv, turns, vary=4):
    roles = ["user", "assistant", "system", "tool", "u", None, ""]
    return [(conv, rng.choice([k, k, k, k // 2, None]), rng.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], rng.choice([None, "", " \n", "cut", "what? ", "hi.", *(f"text {j}." for j in range(vary))])) for k in range(turns)]


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_random_conversations(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [r for conv in range(150) for r in made(rng, conv, rng.randrange(1, 14))] + [r for r in made(rng, None, 9)]
    rows += made(rng, 1000, 700, vary=1000)  # one conversation with a third of all rows
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert run(spark, rows, block_rows=block_rows) == {k: report(v) for k, v in groups.items()}


def test_edges(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "all rows dropped"), (None, None, None, None), (2, 5, "user", "Is it? " + "long " * 100_000 + "."), (2, 5, "user", "Is it? "), (3, 1, "üser", "Ja.")]
    out = run(spark, rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert out == {k: report(v) for k, v in groups.items()}
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, rows[:0]) == {}


def test_rows_of_the_repair(spark):
    rows = [("a", 0, "assistant", "Hello."), ("a", 1, "user", "Hi."), ("a", 2, "user", "cut off"), ("a", 3, "user", " "), ("b", 0, "system", "Be brief.")]
    df = spark.createDataFrame(rows, "conv string, turn long, role string, text string")
    out = {}
    for r in c.repaired_rows(df, block_rows=2).orderBy("conv", "slice", "block", "nth").collect():
        out.setdefault(r["conv"], []).append((r["edit"], r["role"], r["text"]))
    assert out["b"] == [("D", "system", None)]
    assert "".join(e for e, _, _ in out["a"]) == cheapest([("assistant", "Hello.", 0, 0), ("user", "Hi.", 0, 0), ("user", "cut off", 0, 1), ("user", " ", 1, 0)])[1]
    kept = [role for e, role, _ in out["a"] if e != "D"]
    assert kept == ["user", "assistant"] * (len(kept) // 2)


def test_crossings_agree_for_any_cut():
    """Blocks as wholes lead to the same states as single rows."""
    rng = random.Random(5)
    for _ in range(200):
        items = [c.moves(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(1, 30))]
        states = c.crossings(items, 0, c.FINAL)
        cut = sorted(rng.sample(range(1, len(items) + 1), rng.randrange(1, len(items) + 1)) + [0])
        cut = cut if cut[-1] == len(items) else [*cut, len(items)]
        blocks = c._Summaries([c.summary(items[a:b]) for a, b in zip(cut, cut[1:])])
        assert c.crossings(blocks, 0, c.FINAL) == [states[k] for k in cut]
