"""Conversation repair against plain dynamic programming over (cost, audit)."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attemptlog.llm import conversation_repair as cr
from attemptlog.llm import edit_paths as ep

NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def least(rows):
    """(cost, audit, repaired lines) of the cheapest edits; rows are (fault, role, text)."""
    def inserts(best):
        for _ in range(3):
            for q, (c, a, r) in list(best.items()):
                role, t = NEXT[q]
                v = (c + 3, a + "I", r + (role + ":",))
                if t not in best or v[:2] < best[t][:2]:
                    best[t] = v
        return best
    best = {0: (0, "", ())}
    for fault, role, text in rows:
        new = {}

        def put(q, c, a, r):
            if q not in new or (c, a) < new[q][:2]:
                new[q] = (c, a, r)
        for q, (c, a, r) in inserts(dict(best)).items():
            put(q, c + 4, a + "D", r)
            if fault in (1, 2):
                continue
            extra = 3 if fault == 3 else 0
            if q in KEEP.get(role[:1], {}):
                put(KEEP[role[:1]][q], c + extra, a + "K", r + (f"{role}:{text}",))
            put(NEXT[q][1], c + 3 + extra, a + "R", r + (f"{NEXT[q][0]}:{text}",))
        best = new
    best = inserts(best)
    return min(best[q] for q in (0, 3) if q in best)


def digest(role, text):
    r = role.encode()
    return hashlib.sha256(f"{len(r)}:".encode() + r + text.encode()).digest()


def brute(conv):
    """Contract's columns of one conversation; rows are (turn, role, text)."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in conv],
                  key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), digest(z[1], z[2])))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = least([(f, r, x) for f, (_, r, x) in zip(faults, rows, strict=True)])
    return (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(conv_id, rows):
    out = []
    for turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


TABLE = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def frame(spark, convs, parts=4):
    rows = [(c, *r) for c, rs in convs for r in rs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TABLE).repartition(parts)


def collected(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "s"]
TEXTS = ["Hello.", "Yes!  \n", "cut off", "", " \t", None, "Why?", "ünd so", "a. ", "x" * 5000 + "."]


def random_conversation(rnd, n, ordered):
    turns = list(range(n)) if ordered else [rnd.choice([None, *range(max(1, n))]) for _ in range(n)]
    return [(t, rnd.choice(ROLES[:4] if rnd.random() < 0.8 else ROLES), rnd.choice(TEXTS) if rnd.random() < 0.5 else f"t{rnd.random()}.")
            for t in turns]


def test_least_audits_of_many_pieces():
    rnd = random.Random(2)
    convs = [[(rnd.choice([0, 0, 0, 1, 2, 3]), rnd.choice(["system", "user", "user", "assistant", "tool"]), "x")
              for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 13, 40]))] for _ in range(600)]
    where = {"system": 0, "user": 1, "assistant": 2, "tool": 3}
    codes = np.array([ep.code_of(f, where[r]) for c in convs for f, r, _ in c], np.int64)
    ends, n = np.cumsum([len(c) for c in convs]), len(convs)
    after = np.broadcast_to(ep.END, (n, 4))
    cost = ep.through(ep.matrices(codes, ends), after)[:, 0]
    letters, upto, state = ep.least_audits(codes, ends, after, np.ones(n, bool), np.stack([np.arange(n), np.zeros(n, int)], 1))
    text, at = bytes(letters).decode(), 0
    for k, c in enumerate(convs):
        assert (cost[k], text[at:upto[k]]) == least(c)[:2]
        at = upto[k]
    assert set(state.tolist()) <= {0, 3}


@pytest.mark.parametrize("block", [4096, 4, 1])
def test_repair_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK_BITS", block.bit_length() - 1)
    rnd = random.Random(block)
    convs = [(k, random_conversation(rnd, rnd.choice([1, 2, 3, 5, 8, 30]), k % 2 == 0)) for k in range(60)]
    convs += [(None, random_conversation(rnd, 9, True)), (1000, random_conversation(rnd, 400, True)),
              (1001, [(0, "user", "Same.")] * 30), (1002, [(None, "user", "A."), (None, "assistant", "B.")])]
    got = collected(cr.repair_conversations(frame(spark, convs).withColumns({c: F.lit("clash") for c in (
        "key", "code", "audit", "cost", "_p", "_pos", "digest", "kind", "blank", "there", "block")})))
    assert got == {c: brute(rows) for c, rows in convs}


def test_damaged_conversations(spark):
    rnd = random.Random(11)
    convs = [(k if k else None, random_conversation(rnd, rnd.choice([1, 1, 2, 4, 9]), k % 3 > 0)) for k in range(150)]
    got = collected(cr.repair_damaged(frame(spark, convs)))
    assert got == {c: brute(damaged(c, rows)) for c, rows in convs}
    assert any(not damaged(c, rows) for c, rows in convs)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", empty) for c, rows in convs if not damaged(c, rows))


def test_empty_table(spark):
    assert cr.repair_damaged(spark.createDataFrame([], TABLE)).collect() == []
