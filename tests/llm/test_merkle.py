"""Merkle manifest against a plain recursive version."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attemptlog.llm import merkle
from tests.llm.helpers import docs_frame, with_clashes


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in
                 (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grow(hashes):
    """Root, and for each leaf its (left, right) siblings level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for p, k in zip(paths, at, strict=True):
            run = hashes[k // 8 * 8:k // 8 * 8 + 8]
            p.append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        hashes, at = [sha(*hashes[i:i + 8]) for i in range(0, len(hashes), 8)], [k // 8 for k in at]
    return hashes[0], paths


def brute(rows, tampered):
    groups = {}
    for r in rows:
        leaf = leaf_of(r, r["text"])
        other = leaf_of(r, lowered(r["text"])) if r["doc_id"] is not None and r["doc_id"] in tampered else None
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, inner = [], []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2] is not None, x[2] or ""))
        top, paths = grow([x[1] for x in groups[g]])
        tops.append(top)
        inner.append(paths)
    root, outer = grow(tops)
    out = []
    for g, top, paths, up in zip(names, tops, inner, outer, strict=True):
        for (key, leaf, other), path in zip(groups[g], paths, strict=True):
            acc = other or leaf
            for left, right in path + up:
                acc = sha(left, acc, right)
            out.append((key, leaf, top, root, sha(*[x + y for x, y in path + up]), acc, acc == root))
    return sorted(out, key=repr)


def made(df, tampered):
    leaf = lambda t: merkle.leaf_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [t])
    out = merkle.merkle_manifest(df, leaf(F.col("text")), other_leaf=F.when(
        F.col("doc_id").isin(sorted(tampered)), leaf(merkle.lower_ascii(F.col("text")))))
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["verified"])
                   for r in out.withColumn("proof", merkle.proof_hash(F.col("path"))).collect()], key=repr)


def test_many_groups_and_odd_rows(spark):
    rnd = random.Random(5)
    sizes = {"en": 75, None: 9, "fr": 1, "de": 8, "": 2, "-": 1, "zz": 17, "été": 3, "e": 1, "+": 2}
    langs = [g for g, n in sizes.items() for _ in range(n)]
    ids = [None if k % 23 == 5 else k // 2 if k % 17 == 3 else k for k in range(len(langs))]
    texts = [None if k % 29 == 1 else "" if k % 31 == 2 else "Ä" * (k % 7) + " A b" for k in range(len(langs))]
    order = list(range(len(langs)))
    rnd.shuffle(order)
    df = docs_frame(spark, [texts[k] for k in order], [langs[k] for k in order], ids=[ids[k] for k in order], parts=5)
    rows = [r.asDict() for r in df.collect()]
    tampered = {k for k in range(len(langs)) if k % 3 == 0}
    want = brute(rows, tampered)
    assert made(with_clashes(df).withColumns({c: F.lit(1) for c in ("grp", "idx", "leaf", "path", "root", "hash", "_key")}),
                tampered) == want
    assert {r[6] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_single_group(spark, n):
    df = docs_frame(spark, [f"Text {k}" for k in range(n)])
    assert made(df, {0, 3}) == brute([r.asDict() for r in df.collect()], {0, 3})


def test_repeated_rows_and_empty(spark):
    df = docs_frame(spark, ["Same"] * 20 + [None] * 3, ids=[7] * 20 + [None] * 3)
    assert made(df, {7}) == brute([r.asDict() for r in df.collect()], {7})
    empty = made(docs_frame(spark, []), {0})
    assert empty == []
