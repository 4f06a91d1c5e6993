"""SimHash fingerprints and their groups against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from attemptlog.llm import simhash, tokens
from attemptlog.llm.xxh import xxh64
from tests.llm.helpers import docs_frame, with_clashes

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(keys, prints):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(keys)):
        members.setdefault(find(i), []).append(keys[i])
    least = {r: min([k for k in m if k is not None], default=None) for r, m in members.items()}
    return [least[find(i)] for i in range(len(keys))]


def test_xxh64_of_ranges():
    rnd = random.Random(3)
    raw = bytes(rnd.randrange(256) for _ in range(5000))
    data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)])
    size = np.array([rnd.choice([0, 1, 4, 7, 8, 15, 31, 32, 33, 63, 64, 100, 255, 256, 257, 900]) for _ in range(800)])
    start = np.array([rnd.randrange(4100) for _ in size])
    want = [xxhash.xxh64_intdigest(raw[s:s + n], 42) for s, n in zip(start, size, strict=True)]
    assert xxh64(data, start, start + size).tolist() == want


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \n\t", "A", "a  b", "A\tb\nC", "one two three Four", "x " * 70_000, "long" * 500 + " b c d",
             "Ä é ü ß 漢字 a", "a" * 40 + " " + "b" * 40 + " c d e f"] + [f"w{k} " * k for k in range(30)]
    got = []
    for _, _, data, offsets in tokens.slices(pa.array(texts, pa.string()), limit=1 << 12):
        got += simhash.fingerprints(data, offsets).tolist()
    assert got == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("bucket", [64, 3, 0])
def test_pairs_near_each_other(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(bucket)
    prints = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(12):                      # families of few differing bits, and ones two to four bits apart
        at = rnd.getrandbits(64)
        for _ in range(25):
            at ^= sum({1 << rnd.randrange(64) for _ in range(rnd.choice([1, 2, 2, 3, 4]))})
            prints.add(at)
    low = rnd.getrandbits(32)                # many with equal low halves
    prints |= {low | (rnd.getrandbits(6) << 40) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)).collect()
    assert all(bin((r["src"] ^ r["dst"]) & ((1 << 64) - 1)).count("1") <= 2 for r in edges)
    group = {p: {p} for p in signed}
    for r in edges:
        a, b = group[r["src"]], group[r["dst"]]
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    want = components(prints, prints)
    assert [min(x % (1 << 64) for x in group[p]) for p in signed] == want


def test_components_of_documents(spark):
    rnd = random.Random(9)
    base = [" ".join(f"w{rnd.randrange(400)}" for _ in range(300)) for _ in range(6)]
    texts, ids = [], []
    for b in base:
        words = b.split()
        for k in range(12):
            w = list(words)
            for _ in range(k % 4):
                w[rnd.randrange(len(w))] = "x"
            texts.append(("  " if k % 2 else "\n").join(w).upper() if k == 5 else " ".join(w))
    texts += [None, "", " ", "a", "A", "a b", "a b c"] + [base[0]] * 40
    ids = [rnd.randrange(10_000) for _ in texts]
    ids[3] = ids[20] = ids[-1] = None
    prints = [fingerprint(t) for t in texts]
    want = sorted(zip(ids, [f"{p:016x}" for p in prints], components(ids, prints), strict=True), key=repr)
    got = simhash.simhash_components(with_clashes(docs_frame(spark, texts, ids=ids, parts=4)))
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()], key=repr) == want
    assert len(set(prints)) > 10 and len({w[2] for w in want}) > 5


def test_empty_table_and_only_null_ids(spark):
    assert simhash.simhash_components(docs_frame(spark, [])).collect() == []
    got = simhash.simhash_components(docs_frame(spark, ["a", None], ids=[None, None])).collect()
    assert {r["component_id"] for r in got} == {None}
