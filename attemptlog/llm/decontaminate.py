"""Benchmark passages in training text, found through suffix arrays of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlog.llm import tokens

#: Words of the benchmark searched in one pass; a larger benchmark takes more passes.
BLOCK_WORDS = 1_000_000
HIT = "struct<start:int,end:int,item:string,item_at:int,longest:int>"
_ARROW_HIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string()), ("item_at", pa.int32()),
                        ("longest", pa.int32())])


@dataclass
class Block:
    """Items of a benchmark, their words numbered from 1 by the sorted hashes."""

    names: list[str]
    vocab: np.ndarray       # sorted hashes
    words: np.ndarray       # all items, a 0 after each, zeros at the end
    test_at: np.ndarray     # starts of the test suffixes: those that a window begins
    test_len: np.ndarray    # words of that window
    test_item: np.ndarray
    item_at: np.ndarray     # first word of each item
    pairs: np.ndarray       # sorted: the first two words of each window, 0 after a lone word
    depth: int              # words of the longest item


def make_block(items: list[tuple[str, str]], window: int) -> Block:
    texts = pa.array([t for _, t in items], pa.large_string())
    hashes: list[np.ndarray] = []
    for _, _, data, offsets in tokens.slices(texts):
        s, e, at = tokens.word_spans(data, offsets, tokens.WORD_BYTE)
        h = tokens.word_hashes(data, s, e)
        hashes += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    vocab = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    depth = max([window, *map(len, hashes)])
    words, test_at, test_len, test_item, item_at, n = [], [], [], [], [], 0
    for k, h in enumerate(hashes):
        item_at.append(n)
        if len(h):
            w = min(window, len(h))
            at = np.arange(n, n + len(h) - w + 1)
            test_at.append(at)
            test_len.append(np.full(len(at), w))
            test_item.append(np.full(len(at), k))
        words += [np.searchsorted(vocab, h) + 1, np.zeros(1, np.int64)]
        n += len(h) + 1
    flat = np.concatenate([*words, np.zeros(depth + 3, np.int64)]).astype(np.int64)
    join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    at, size = join(test_at), join(test_len)
    pairs = np.unique((flat[at] << 31) | np.where(size > 1, flat[at + 1], 0))
    return Block([name for name, _ in items], vocab, flat, at, size, join(test_item), np.array(item_at, np.int64),
                 pairs, depth)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    k = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[k] == x


def number_words(block: Block, h: np.ndarray) -> np.ndarray:
    """The block's number of each hashed word, 0 for words it does not have.  A table
    over 16 bits of the hash turns most other words away."""
    seen = np.zeros(1 << 16, bool)
    seen[(block.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
    ids = np.zeros(len(h), np.int64)
    if len(block.vocab):
        k = np.minimum(np.searchsorted(block.vocab, h[maybe]), len(block.vocab) - 1)
        ids[maybe] = np.where(block.vocab[k] == h[maybe], k + 1, 0)
    return ids


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` that start at ``at`` in lexicographic order.

    Words are compared up to ``depth`` or the first 0, two words a step; after a
    step only suffixes that still tie go on.  ``ids`` ends with ``depth`` + 2 zeros."""
    def two(p: np.ndarray, k: int) -> np.ndarray:
        a = ids[p + k]
        return (a << 31) | np.where(a > 0, ids[p + k + 1], 0)
    key = two(at, 0)
    order = np.argsort(key, kind="stable")
    sa, key = at[order], key[order]
    head = np.ones(len(sa), bool)
    head[1:] = key[1:] != key[:-1]
    for k in range(2, depth, 2):
        alive = (key & 0x7FFFFFFF) > 0
        tied = ~head
        tied[:-1] |= ~head[1:]
        live = np.flatnonzero(tied & alive)
        if not len(live):
            break
        group = np.cumsum(head)[live]
        nxt = two(sa[live], k)
        order = np.lexsort((nxt, group))
        sa[live], nxt = sa[live][order], nxt[order]
        key = np.zeros(len(sa), np.int64)
        key[live] = nxt
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        head[live] = new | head[live]
    return sa


def search(ids: np.ndarray, sa: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For every test suffix the range of the suffix array whose suffixes begin with
    its window, by binary search for all test suffixes together."""
    n_test, most = len(block.test_at), int(block.test_len.max(initial=0))

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(n_test, np.int64), np.full(n_test, len(sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            p, t, size = sa[mid], block.test_at[open_], block.test_len[open_]
            sign = np.zeros(len(open_), np.int64)
            for d in range(most):
                go = np.flatnonzero((sign == 0) & (d < size))
                if not len(go):
                    break
                sign[go] = np.sign(ids[p[go] + d] - block.words[t[go] + d])
            right = (sign < 0) | (upper & (sign == 0))
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        return lo
    return bound(False), bound(True)


def find_hits(block: Block, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal hit spans of a shard: row, start, end (words in the row, end
    exclusive), item, place in the item of the longest match, its length.

    ``h`` has the hashes of the shard's words, ``first`` each row's first word.
    The suffix array holds every suffix that starts with the first two words
    of some window; no other suffix can begin with a window."""
    n_rows = len(first) - 1
    row_of = np.repeat(np.arange(n_rows), np.diff(first))
    ids = np.zeros(len(h) + n_rows + block.depth + 3, np.int64)      # a 0 after each row
    ids[np.arange(len(h)) + row_of] = number_words(block, h)
    here = np.flatnonzero(ids)
    key = ids[here] << 31
    here = here[_member(block.pairs, key | ids[here + 1]) | _member(block.pairs, key)]
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if not len(here) or not len(block.test_at):
        return empty
    sa = suffix_array(ids, here, block.depth)
    lo, hi = search(ids, sa, block)
    count = hi - lo
    if not count.sum():
        return empty
    test = np.repeat(np.arange(len(count)), count)
    p = sa[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    size = block.test_len[test].copy()
    going = np.arange(len(p))
    while len(going):       # how far the text goes on as the test suffix does
        a, b = ids[p[going] + size[going]], block.words[block.test_at[test[going]] + size[going]]
        going = going[(a == b) & (a > 0)]
        size[going] += 1
    bounds = first[:-1] + np.arange(n_rows)
    row = np.searchsorted(bounds, p, "right") - 1
    start = p - bounds[row]
    item = block.test_item[test]
    order = np.lexsort((start, item, row))
    row, start, item, size, test = (x[order] for x in (row, start, item, size, test))
    end = start + block.test_len[test]
    new = np.ones(len(row), bool)   # overlapping windows of one row and item become one span
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])
    heads = np.flatnonzero(new)
    span = np.cumsum(new) - 1
    best = np.lexsort((-size, span))[np.searchsorted(span, np.arange(len(heads)))]
    return (row[heads], start[heads], np.maximum.reduceat(end, heads), item[heads],
            (block.test_at - block.item_at[block.test_item])[test[best]], size[best])


def blocks_of(benchmark: DataFrame, window: int, item_id: str, text: str, limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark as blocks of at most ``limit`` words (or one longer item), read
    row by row."""
    held, words = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))
    for name, t in rows.toLocalIterator():
        n = len(t) // 2 + 1         # words and separators never exceed this
        if held and words + n > limit:
            yield make_block(held, window)
            held, words = [], 0
        held.append((name, t))
        words += n
    if held:
        yield make_block(held, window)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS,
                   out: tuple[str, str] = ("n_words", "hits")) -> DataFrame:
    """Benchmark passages in every row of ``docs``.

    Adds ``n_words`` and ``hits`` (or the names in ``out``): per maximal run of text words covered by windows
    of one item its words ``start`` to ``end``, the item, and the longest verbatim
    match with its place in the item.  A window is ``window`` consecutive words
    of an item; shorter items are one window; items without words have none.
    ``keep`` names the columns to keep (all by default).

    Every slice of about 4 MB of an input partition is a shard with a suffix array
    of its own, over whole texts; every test suffix is binary-searched in each.
    The benchmark is broadcast in blocks of at most ``block_words`` words, one
    narrow pass over the documents a block, so neither documents nor hits are
    shuffled, and memory holds one shard and one block.  Words are compared by
    64-bit hash.

    Null and empty texts have no words and no hits; an empty benchmark gives no
    hits; columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    own = [c for c in dict.fromkeys([*keep, text])]
    found = docs.select(*own).withColumn(out[0], F.lit(0).cast("long")).withColumn(
        out[1], F.array().cast(f"array<{HIT}>"))
    blocks = list(blocks_of(benchmark, window, item_id, item_text, block_words)) or [make_block([], window)]
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        names = own if k + 1 < len(blocks) else keep
        schema = T.StructType([found.schema[c] for c in [*names, *out]])
        found = found.mapInArrow(_search_with(shared, names, text, out), schema)
    return found


def _search_with(shared, names: list[str], text: str, out: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for lo, hi, data, offsets in tokens.slices(batch.column(text)):
                s, e, first = tokens.word_spans(data, offsets, tokens.WORD_BYTE)
                row, start, end, item, item_at, longest = find_hits(block, tokens.word_hashes(data, s, e), first)
                part = batch.slice(lo, hi - lo)
                before = part.column(out[1]).to_pylist() if pc.any(
                    pc.greater(pc.list_value_length(part.column(out[1])), 0)).as_py() else None
                names_of = [block.names[k] for k in item.tolist()]
                new = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(names_of, pa.string()),
                     pa.array(item_at, pa.int32()), pa.array(longest, pa.int32())], fields=list(_ARROW_HIT))
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(at), new)
                if before is not None:
                    hits = pa.array([(a or []) + (b or []) for a, b in zip(before, hits.to_pylist(), strict=True)],
                                    pa.list_(_ARROW_HIT))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(np.diff(first), pa.int64()), hits],
                    names=[*names, *out])
    return run


def covered_words(hits):
    """Words covered by at least one of the spans of a row."""
    spans = F.sort_array(F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["until"], x["end"]).alias("until"),
                                (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["until"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    found = find_benchmark(docs, benchmark, window, text, out=("_n_words", "_hits"))
    return found.filter(F.size("_hits") == 0).select(*docs.columns)
