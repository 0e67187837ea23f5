"""Conversation repair against exhaustive search and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from studyloom.llm import conversation_repair as CR

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, lines): the least over all edits, carried as whole strings; states are the initials given so far."""

    def state(s):
        return "" if not s else s[-1]

    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    ways = {"": (0, "", ())}

    def put(into, key, value):
        if key not in into or value < into[key]:
            into[key] = value

    def inserted(ways):
        out = dict(ways)
        for q, (cost, audit, lines) in ways.items():
            for _ in range(3):
                r = nxt[q]
                cost, audit, lines, q = cost + 2, audit + "I", (*lines, ({"u": "user", "a": "assistant"}[r], "")), r
                put(out, q, (cost, audit, lines))
        return out

    for (_, _, role, text), mark in zip(rows, marks):
        after, cut = {}, 1 if mark == "truncated" else 0
        every = []  # before a row, also ways that aren't the cheapest to their state
        for q, (cost, audit, lines) in ways.items():
            for k in range(4):
                every.append((q, cost, audit, lines))
                r = nxt[q]
                q, cost, audit, lines = r, cost + 2, audit + "I", (*lines, ({"u": "user", "a": "assistant"}[r], ""))
        for q, cost, audit, lines in every:
            put(after, q, (cost + 3, audit + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            r = nxt[q]
            put(after, r, (cost + 2 + cut, audit + "R", (*lines, ({"u": "user", "a": "assistant"}[r], text))))
            i = role[:1]
            if (i == "s" and q == "") or (i in "ua" and i == r and i):
                put(after, i, (cost + cut, audit + "K", (*lines, (role, text))))
        ways = after
    final = inserted(ways)
    return min(final[q] for q in ("", "a") if q in final)


def expected(rows):
    out = []
    for c in {r[0] for r in rows}:
        mine = [r for r in damaged(rows) if r[0] == c]
        marks = faults(mine)
        n = Counter(marks)
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(mine, marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], pairs, cost, audit, sha))
    return sorted(out, key=str)


NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def got(df):
    return sorted((tuple(r[x] for x in NAMES) for r in df.collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 40)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sys", "USER"])
            text = rng.choice(["Hi.", "Well", None, "", " \n", "So?", "Yes! ", "é…", f"t{rng.randrange(9)}."])
            rows.append((c, rng.choice([t, t, t, None, 5]), role, text))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (77, None, "user", "x"), (78, 3, "system", "only.")]
    rows += [(99, t, "user" if t % 3 else "assistant", f"line {t % 50}.") for t in range(700)]
    return rows + rows[:5]


@pytest.mark.parametrize("stretch", [1024, 7])
def test_repair(spark, stretch, monkeypatch):
    if stretch == 7:
        monkeypatch.setattr(CR, "FAN", 5)
        monkeypatch.setattr(CR, "BLOCK", 64)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(CR.repair_report(df, stretch)) == expected(rows)


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(CR.repair_report(df)) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_exhaustive():
    """Costs, audits and states of the two-vector search against every sequence of edits."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    for codes in [*product([0, 1, 2, 3, 6, 10, 11], repeat=2), *product([1, 2, 3, 10], repeat=4)]:
        best = None

        def walk(i, q, cost, audit, inserts):
            nonlocal best
            if i == len(codes) and q in ("", "a"):
                best = min(best or (cost, audit), (cost, audit))
            if inserts < 3:
                walk(i, nxt[q], cost + 2, audit + "I", inserts + 1)
            if i < len(codes):
                cut = 1 if codes[i] & 8 else 0
                walk(i + 1, q, cost + 3, audit + "D", 0)
                if not codes[i] & 4:
                    walk(i + 1, nxt[q], cost + 2 + cut, audit + "R", 0)
                    kind = {1: "s", 2: "u", 3: "a"}.get(codes[i] % 4)
                    if (kind == "s" and q == "") or kind == nxt[q]:
                        walk(i + 1, kind, cost + cut, audit + "K", 0)

        walk(0, "", 0, "", 0)
        which = np.array(codes)
        cost, rank = CR.forward(which, CR.ROW_COST, CR.ROW_RANK, np.array([0]), np.array([len(codes)]), np.array([0]))
        tails = cost[0] + CR.INSERT * np.array(CR.TAIL)
        end = int(np.argmin(tails * 8 + rank[0]))
        before, after = CR.crossings(which, CR.ROW_COST, CR.ROW_RANK, np.array([0]), np.array([len(codes)]), np.array([0]), np.array([end]))
        edits = CR.ROW_EDIT[which, before, after]
        audit = "".join("I" * (e // 3) + "DKR"[e % 3] for e in edits) + "I" * CR.TAIL[end]
        assert (tails[end], audit) == best, codes


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(CR.repair_report(empty)) == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", node int, place int, edits int, chance int")
    assert got(CR.repair_report(df)) == expected(rows)


def test_repaired_rows(spark):
    """The edited rows say what the conversation reads now."""
    rows = [(c, t, r, x) for c, t, r, x in odd_rows() if c is not None and c < 20]
    repaired, whole, _ = CR.repair(spark.createDataFrame(rows, SCHEMA), 7)
    found = sorted(repaired.collect(), key=lambda r: (r["conv_id"], r["place"], r["step"]))
    for c in {r[0] for r in rows}:
        assert GOOD.match("".join(r["role"][:1] for r in found if r["conv_id"] == c and r["edit"] != "D"))
