import random
import re

import numpy as np
import pytest

from attemptlog.llm import decontaminate, ngram_join, signature_tree, tokens
from tests.llm.helpers import DOCS, docs_frame, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def hits_by_hand(text, items, window):
    w, hit, names = words_of(text), set(), set()
    for name, t in items:
        b = words_of(t)
        n = min(window, len(b))
        grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(str(name) if name is not None else "null")
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [1_000_000, 30])
def test_hits_match_brute_force(spark, block_words):
    rng = random.Random(8)
    vocab = ["a", "b", "Cé", "d1", "x"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(4, 14))) for k in range(12)] + [(50, "zz"), (51, None), (52, "..."), (None, "yy xx yy"), (1, text(6))]
    docs = [text(rng.randint(0, 60)) for _ in range(60)] + [None, "", "zz", "A, B! yy XX YY", items[0][1] * 3, "w " * 50_000 + items[3][1]]
    df = with_clashes(docs_frame(spark, docs, ids=[i % 60 for i in range(len(docs))]).withColumnRenamed("n_chars", "row"))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    found = decontaminate.find_benchmark(df, bench, window=5, block_words=block_words)
    rows = found.select("text", "n_words", "hits", decontaminate.covered_words(found["hits"]).alias("n_hit")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_words"], r["n_hit"], sorted({h["item"] for h in r["hits"]})) == hits_by_hand(r["text"], items, 5)
        w = words_of(r["text"])
        for h in r["hits"]:     # the longest match is verbatim and lies in the span
            b = [words_of(t) for name, t in items if str(name if name is not None else "null") == h["item"]]
            m = h["longest"]
            assert any(x[h["item_at"]:h["item_at"] + m] == w[i:i + m] and len(x) >= h["item_at"] + m
                       for x in b for i in range(h["start"], h["end"] - m + 1))
    clean = decontaminate.decontaminate(df, bench, window=5)
    assert clean.columns == df.columns
    assert clean.count() == sum(not hits_by_hand(t, items, 5)[1] for t in docs)


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = docs_frame(spark, ["a b c", None])
    assert [r["hits"] for r in decontaminate.find_benchmark(df, none).collect()] == [[], []]
    assert decontaminate.find_benchmark(spark.createDataFrame([], DOCS), none).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 4, 400), np.zeros(30, np.int64)])
    at = np.flatnonzero(ids)
    sa = decontaminate.suffix_array(ids, at, 20)

    def key(p):
        out = []
        for d in range(20):
            out.append(int(ids[p + d]))
            if out[-1] == 0:
                break
        return out
    assert sorted(sa.tolist()) == at.tolist()
    keys = [key(p) for p in sa]
    assert all(a <= b for a, b in zip(keys, keys[1:]))


def test_word_hashes_tell_words_apart():
    import pyarrow as pa
    texts = ["the The THE", "a" * 7 + " " + "a" * 8 + " " + "a" * 9 + " " + "a" * 17, None, "", "é é ü", "x\ty\nz"]
    (_, _, data, offsets), = tokens.slices(pa.array(texts))
    s, e, first = tokens.word_spans(data, offsets, tokens.NOT_SPACE)
    h = tokens.word_hashes(data, s, e)
    per = [h[a:b] for a, b in zip(first[:-1], first[1:])]
    assert [len(p) for p in per] == [3, 4, 0, 0, 3, 3]
    assert len(set(per[0].tolist())) == 1 and len(set(np.concatenate(per).tolist())) == 11


def brute_links(sets, num, den):
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def parts_of(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("m, sides, num", [(5, False, 85), (16, False, 85), (60, False, 85), (200, False, 85), (90, True, 85),
                                           (200, False, 20), (90, True, 30)])
def test_tree_join_connects_what_links_connect(m, sides, num):
    rng = np.random.default_rng(m)
    bases = [rng.integers(0, 2 ** 62, int(k)).astype(np.uint64) for k in rng.integers(3, 900, max(2, m // 6))]
    sets = []
    for _ in range(m):
        b = bases[rng.integers(len(bases))]
        keep = rng.random(len(b)) > rng.choice([0, 0.02, 0.08, 0.2] if num == 85 else [0, 0.2, 0.5, 0.7, 0.77])
        sets.append(np.unique(np.concatenate([b[keep], rng.integers(0, 2 ** 62, int(len(b) * rng.choice([0, 0.03, 0.1])) + 1).astype(np.uint64)])))
    side = rng.integers(0, 2, m) if sides else None
    links = brute_links([set(s.tolist()) for s in sets], num, 100)
    if sides:
        links = {(i, j) for i, j in links if side[i] != side[j]}
    n = np.array([len(s) for s in sets])

    def linked(i, j):
        return np.array([(min(a, b), max(a, b)) in links for a, b in zip(i.tolist(), j.tolist())], bool)
    got = signature_tree.tree_join([signature_tree.signature(s) for s in sets], n, num, 100, linked, side)
    assert parts_of(m, got) == parts_of(m, links) and len(got) == m - len(set(parts_of(m, links)))


def shingles_by_hand(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("blocks, class_bits, num", [(False, 64, 85), (True, 64, 85), (False, 4, 85), (False, 64, 30)])
def test_components_match_brute_force(spark, blocks, class_bits, num, monkeypatch):
    if blocks:      # groups of any size are joined by pairs of small blocks, members by a shuffle
        monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
        monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(ngram_join, "HOT_TIMES", 0)
        monkeypatch.setattr(ngram_join, "HOT_ROWS", 3)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "x", "yz"]) + rng.choice("123")
    bases = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(110):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + common
        texts.append(rng.choice([" ", "\n"]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    texts += [None, None, "", " \n", "a b", "a b", "a b c", "the the the the the the", "q " * 30_000, texts[0], texts[0]]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = with_clashes(docs_frame(spark, texts, ids=ids))
    rows = ngram_join.ngram_components(df, num=num, class_bits=class_bits).collect()
    assert len(rows) == len(texts)
    sets = [shingles_by_hand(t, 4) for t in texts]
    part = parts_of(len(texts), brute_links(sets, num, 100))
    least = {}
    for k, p in enumerate(part):
        least[p] = min(least.get(p, 10 ** 9), ids[k])
    want = {ids[k]: (len(sets[k]), least[part[k]]) for k in range(len(texts))}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_components_of_odd_tables(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = ngram_join.ngram_components(docs_frame(spark, ["a b c d e", "a b c d e", None], ids=[None, 4, None])).collect()
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in rows) == [(0, -1), (2, 4), (2, 4)]


def test_common_tokens_of_sets_by_bits_and_by_marks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, size).astype(np.uint64)) for size in rng.integers(1, 40, 50)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert ngram_join.shared_tokens(sets)(i, j).tolist() == want
    assert ngram_join.shared_tokens(sets, limit=0)(i, j).tolist() == want


def test_family_of_near_misses():
    import time

    from attemptlog.llm.signature_tree import signature, tree_join
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = []
    for _ in range(8192):               # 18 of 200 tokens differ: similarity about 0.7, no links under 0.85
        x = base.copy()
        x[rng.choice(200, 18, replace=False)] = rng.integers(0, 1 << 63, 18).astype(np.uint64)
        sets.append(np.unique(x))
    sets += [sets[7][1:], sets[8191][2:]]
    n, both = np.array([len(x) for x in sets]), ngram_join.shared_tokens(sets)

    def linked(i, j):
        k = both(i, j)
        return 100 * k >= 85 * (n[i] + n[j] - k)
    began = time.time()
    joined = tree_join([signature(x) for x in sets], n, 85, 100, linked)
    assert time.time() - began < 120
    assert sorted(tuple(sorted(p)) for p in joined) == [(7, 8192), (8191, 8193)]
