"""Sharding by longest processing time: large groups first, to the least-loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.splits import global_rank
from attemptlog.session import cut_lineage

#: From so many groups of one size on, they are dealt by level instead of one by one.
BULK = 256
_CLASS = "group_bytes long, shards array<int>, upto array<long>"


def _deal_level(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each shard gets when every one goes to
    the least-loaded shard (the lower number on ties)."""
    if size <= 0:
        least = loads.index(min(loads))
        return [count if k == least else 0 for k in range(len(loads))]

    def under(level: int) -> int:
        return sum((level - x + size - 1) // size for x in loads if x < level)
    lo, hi = min(loads), max(loads) + size * (count + 1)
    while hi - lo > 1:                  # the highest level below which at most ``count`` groups start
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if under(mid) <= count else (lo, mid)
    got = [max(0, (lo - x + size - 1) // size) for x in loads]
    left = count - sum(got)
    for k, x in enumerate(loads):
        if left and x + got[k] * size == lo:
            got[k], left = got[k] + 1, left - 1
    return got


def deal_classes(classes: Iterable[tuple[int, int]], n_shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """LPT over (size, number of groups) pairs in falling order of size.  Gives per
    size the shards used and, running, how many of its groups went to them."""
    heap = [(0, k) for k in range(n_shards)]
    for size, count in classes:
        got: dict[int, int] = {}
        if count < BULK:
            for _ in range(count):
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                got[k] = got.get(k, 0) + 1
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            dealt = _deal_level(loads, size, count)
            got = {k: n for k, n in enumerate(dealt) if n}
            heap = [(load + n * size, k) for k, (load, n) in enumerate(zip(loads, dealt, strict=True))]
            heapq.heapify(heap)
        shards, upto, at = sorted(got), [], 0
        for k in shards:
            at += got[k]
            upto.append(at)
        yield size, shards, upto


def assign_shards(docs: DataFrame, n_shards: int = 40, doc_id: str = "doc_id", text: str = "text",
                  overhead: int = 16) -> DataFrame:
    """Shard and slot of every row; rows of equal text stay together.

    Returns ``doc_id``, ``size`` (UTF-8 bytes and ``overhead``), ``text_crc32``,
    ``group`` (sha-256 of the text), ``shard`` and ``slot``, which counts the rows
    of a shard from 0 without gaps.

    Groups are sized by a partial aggregate and counted by size; the heap runs
    over that table of sizes in one task, streaming.  It has at most
    sqrt(2 * total bytes) rows, because different sizes add up, and the heap
    ``n_shards``.  Equal sizes are interchangeable for LPT, so a group finds its
    shard from its rank among the groups of its size.  Ranks and slots are
    numbered over range partitions, which a large group or shard spreads over.

    Null texts are one group of size ``overhead`` a row, with a null checksum;
    repeated rows get slots of their own; ties are ordered by the text's hash,
    then the row's place.  An empty table gives an empty result.
    """
    key = F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("null"))
    base = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), key.alias("group"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row")))
    groups = cut_lineage(base.groupBy("group").agg(F.sum("size").alias("group_bytes")))
    classes = groups.groupBy("group_bytes").agg(F.count(F.lit(1)).alias("n"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = (p for b in batches for p in zip(b["group_bytes"].tolist(), b["n"].tolist(), strict=True))
        rows = []
        for row in deal_classes(pairs, n_shards):
            rows.append(row)
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=["group_bytes", "shards", "upto"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["group_bytes", "shards", "upto"])

    dealt = classes.repartition(1).sortWithinPartitions(F.desc("group_bytes")).mapInPandas(deal, _CLASS)
    ranked = global_rank(groups, ["group"], ["group_bytes"], "_rank")
    nth = F.size(F.filter("upto", lambda u: u <= F.col("_rank"))) + 1
    placed = ranked.join(dealt, "group_bytes").select("group", F.element_at("shards", nth).alias("shard"))
    rows = base.join(placed, "group")
    return global_rank(rows, ["group", "_row"], ["shard"], "slot") \
        .select("doc_id", "size", "text_crc32", "group", "shard", "slot")
