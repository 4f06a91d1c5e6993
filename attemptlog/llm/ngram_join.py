"""Jaccard join on word n-grams: rare-token groups, then signature trees in each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlog.llm import gather, tokens
from attemptlog.llm.graph import connected_components
from attemptlog.llm.signature_tree import signature, tree_join
from attemptlog.session import cut_lineage

#: The sketch counts documents a token, for the order in which rare tokens come first.
SKETCH_BITS = 18
#: Tokens of a bucket with HOT_TIMES the mean count and HOT_ROWS more are spread over HOT_PARTS tasks.
HOT_TIMES, HOT_ROWS, HOT_PARTS = 8, 10_000, 64
#: A group with more documents, or more bytes of sets, is joined block by block.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
#: Exact sets of a piece are compared as rows of bits up to so many bytes.
BITMAP_BYTES = 64 << 20
#: Members of candidate groups are broadcast up to so many, else joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_F1, _F2 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, inside: np.ndarray = tokens.NOT_SPACE
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word ``n``-grams of each row, sorted, end to end, with the rows'
    offsets.  A row of fewer words, but not none, has its whole sequence."""
    s, e, first = tokens.word_spans(data, offsets, inside)
    h = tokens.word_hashes(data, s, e)
    windows = tokens.window_hashes(h, n)
    out, ends = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(windows[a:b - n + 1]))
        elif b > a:
            out.append(tokens.window_hashes(h[a:b], b - a) ^ np.uint64(b - a))
        ends.append(ends[-1] + (len(out[-1]) if b > a else 0))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.array(ends, np.int64)


def _fingerprints(flat: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each set that does not depend on the order of its tokens."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(tokens.mix(flat ^ seed), out=total[1:])
    size = np.diff(ends).astype(np.uint64)
    return tokens.mix((total[ends[1:]] - total[ends[:-1]]) ^ (size * seed))


def _each(batches, text: str, n: int, class_bits: int = 64, renamed: dict[tuple[int, int], int] | None = None):
    """Rows, sets, their ends and classes; sets in ``renamed`` (by both fingerprints)
    have the class given there."""
    shared = np.array(sorted({f1 for f1, _ in renamed or {}}), np.int64)
    for batch in batches:
        for lo, hi, data, offsets in tokens.slices(batch.column(text)):
            flat, ends = shingle_sets(data, offsets, n)
            f1 = _fingerprints(flat, ends, _F1) >> np.uint64(64 - class_bits)
            at = np.flatnonzero(np.isin(f1.view(np.int64), shared)) if renamed else ()
            if len(at):
                f2 = _fingerprints(flat, ends, _F2).view(np.int64)
                cls = f1.view(np.int64)
                cls[at] = [renamed.get(pair, pair[0]) for pair in zip(cls[at].tolist(), f2[at].tolist(), strict=True)]
            yield batch.slice(lo, hi - lo), flat, ends, f1


def _renamed(rows: DataFrame, classes: DataFrame) -> dict[tuple[int, int], int]:
    """New classes for the sets that share one with a different set, by both
    fingerprints.  About ``sets ** 2 / 2 ** 64`` sets do (5 of 1e10), so these alone come to the driver."""
    spark, clash = rows.sparkSession, classes.filter("_clash").select("cls")
    pairs = rows.filter("n > 0").join(clash, "cls", "left_semi").select("cls", "check").distinct().collect()
    f1, f2 = (np.array([r[k] for r in pairs], np.int64).view(np.uint64) for k in (0, 1))
    turn = np.uint64(1)
    while len(pairs):
        new = tokens.mix(tokens.mix(f2 ^ turn) ^ f1).view(np.int64).tolist()
        taken = spark.createDataFrame([(x,) for x in new], "cls long")
        if len(set(new)) == len(new) and classes.join(F.broadcast(taken), "cls", "left_semi").isEmpty():
            return dict(zip(map(tuple, pairs), new, strict=True))
        turn += np.uint64(1)
    return {}


def _signatures(docs: DataFrame, n: int, doc_id: str, text: str, also: list[str], class_bits: int) -> DataFrame:
    """One row a document (id, size, class = 64-bit fingerprint, second fingerprint,
    signature) and, with ``part``, the sketch of each input partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kinds = np.zeros(1 << SKETCH_BITS, np.int32), None
        names = [*ids, "n", "cls", "check", "sig", "part", "counts"]
        for batch, flat, ends, f1 in _each(batches, "text", n, class_bits):
            np.add(counts, np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                                       minlength=len(counts)).astype(np.int32), out=counts)
            kinds = [batch.column(c).type for c in ids]
            sig = [signature(flat[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            k = len(batch)
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ids], pa.array(np.diff(ends)), pa.array(f1.view(np.int64)),
                pa.array(_fingerprints(flat, ends, _F2).view(np.int64)), pa.array(sig, pa.binary()),
                pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if kinds is None:
            return
        none = [pa.nulls(gather.PARTS, t) for t in [*kinds, pa.int64(), pa.int64(), pa.int64(), pa.binary()]]
        yield pa.RecordBatch.from_arrays([*none, *gather.pieces(counts)], names=names)

    ids = ["_key", *also]
    rows = docs.select(F.col(doc_id).alias("_key"), *also, F.col(text).alias("text"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.select(*ids).schema])
    for name, kind in (("n", T.LongType()), ("cls", T.LongType()), ("check", T.LongType()), ("sig", T.BinaryType()),
                       ("part", T.IntegerType()), ("counts", T.BinaryType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def _prefixes(docs: DataFrame, n: int, text: str, sketch: np.ndarray, num: int, den: int, **classes) -> DataFrame:
    """(token, class) for the rarest tokens of each set, so many that linked sets
    share one, and whether the sketch has the token in a hot bucket.  Repeated
    classes of a partition are given once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # any order of tokens does; this one is by the logarithm of the count, then by hash
        sketch = shared.value
        rank = (np.log2(np.maximum(sketch, 1)) * 16).astype(np.uint64) << np.uint64(54)
        hot = sketch > HOT_TIMES * sketch.mean() + HOT_ROWS
        seen: set[int] = set()
        for _, flat, ends, f1 in _each(batches, "text", n, **classes):
            bucket = (flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            key = rank[bucket] | (tokens.mix(flat.copy()) >> np.uint64(10))
            got, cls, at_hot = [], [], []
            for a, b, c in zip(ends[:-1].tolist(), ends[1:].tolist(), f1.view(np.int64).tolist(), strict=True):
                if a == b or c in seen:
                    continue
                seen.add(c)
                take = (b - a) - -(-(b - a) * num // den) + 1
                own = key[a:b]
                at = np.flatnonzero(own <= np.partition(own, take - 1)[take - 1])
                got.append(flat[a + at])
                cls.append(np.full(len(at), c, np.int64))
                at_hot.append(hot[bucket[a + at]])
            if got:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(got).view(np.int64)), pa.array(np.concatenate(cls)),
                    pa.array(np.concatenate(at_hot))], names=["token", "cls", "hot"])
    return docs.select(F.col(text).alias("text")).mapInArrow(run, "token long, cls long, hot boolean")


def _shared_tokens(prefix: DataFrame) -> DataFrame:
    """Distinct (token, class) of tokens that more than one class has, written to the
    shared folder.  Most rare tokens have one class and end here, after one shuffle.
    Tokens of hot buckets are kept as they are and dealt out by class as well."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("cls"), F.lit(HOT_PARTS))).otherwise(0)
    same = Window.partitionBy("token", "_salt")
    found = prefix.withColumn("_salt", salt).withColumn("_least", F.min("cls").over(same)) \
        .withColumn("_most", F.max("cls").over(same)).filter(F.col("hot") | (F.col("_least") != F.col("_most")))
    return cut_lineage(found.select("token", "cls").distinct())


def shared_tokens(sets: list[np.ndarray], limit: int = BITMAP_BYTES) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that counts the tokens sets ``i`` and ``j`` have in common, for many pairs at once.

    Tokens of one set alone cannot be common.  The others get a bit each, so a pair is
    the number of bits in two rows; above ``limit`` bytes of rows, the tokens of a set are
    marked and those of all its partners looked up."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[name]
    row, keep = np.repeat(np.arange(len(sets)), size), place >= 0
    row, place, names = row[keep], place[keep], int((count > 1).sum())
    words = max(1, -(-names // 64))
    if len(sets) * words * 8 <= limit:
        rows = np.zeros((len(sets), words), np.uint64)
        np.add.at(rows, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))    # each bit once

        def by_bits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out, step = np.empty(len(i), np.int64), max(1, (4 << 20) // (8 * words))
            for k in range(0, len(i), step):
                out[k:k + step] = np.bitwise_count(rows[i[k:k + step]] & rows[j[k:k + step]]).sum(1, dtype=np.int64)
            return out
        return by_bits
    starts = np.searchsorted(row, np.arange(len(sets) + 1))
    marked = np.zeros(names, bool)

    def by_marks(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, order = np.empty(len(i), np.int64), np.argsort(i, kind="stable")
        cuts = np.flatnonzero(np.diff(i[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = place[starts[i[order[a]]]:starts[i[order[a]] + 1]]
            marked[own] = True
            for k in order[a:b].tolist():
                out[k] = marked[place[starts[j[k]]:starts[j[k] + 1]]].sum()
            marked[own] = False
        return out
    return by_marks


def _join_groups(members: DataFrame, sets: bool, num: int, den: int) -> DataFrame:
    """Spanning links of every group: ``members`` has ``gid``, ``cls``, ``n``,
    ``payload`` (signature, or the set itself) and ``blocks``, equal in a group.

    A group of several blocks becomes a piece for each pair of blocks, so that a
    piece has two blocks at most.  Pieces are streamed from sorted partitions."""
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    pieces = members.withColumn("own", block).withColumn("_o", other) \
        .select("gid", F.least("own", "_o").alias("lo"), F.greatest("own", "_o").alias("hi"), "own", "cls", "n", "payload") \
        .repartition("gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi")

    def links_of(cls: np.ndarray, n: np.ndarray, payload: list, own: np.ndarray) -> list[tuple[int, int]]:
        cls, first = np.unique(cls, return_index=True)
        n, own, payload = n[first], own[first], [payload[k] for k in first]
        if len(cls) < 2:
            return []
        side = own if own.min() != own.max() else None
        if sets:
            data = [np.frombuffer(x, np.uint64) for x in payload]
            bits = [signature(x) for x in data]
            both = shared_tokens(data)

            def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                k = both(i, j)
                return den * k >= num * (n[i] + n[j] - k)
        else:
            bits = [np.frombuffer(x, np.uint64) for x in payload]

            def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return np.ones(len(i), bool)
        return [(int(cls[a]), int(cls[b])) for a, b in tree_join(bits, n, num, den, linked, side)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []         # rows of the piece that is not yet complete
        last = None

        def flush(rows: list) -> list[tuple[int, int]]:
            cls, n, own = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
            return links_of(cls, n, [p for r in rows for p in r[3]], own)
        for batch in batches:
            gid, lo, hi = (batch.column(c).to_numpy() for c in ("gid", "lo", "hi"))
            cls, n, own = (batch.column(c).to_numpy() for c in ("cls", "n", "own"))
            payload = batch.column("payload")
            new = np.flatnonzero((gid[1:] != gid[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            links: list[tuple[int, int]] = []
            cuts = [0, *new.tolist(), len(gid)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                name = (gid[a], lo[a], hi[a])
                if held and name != last:
                    links += flush(held)
                    held = []
                last = name
                held.append((cls[a:b], n[a:b], own[a:b], payload.slice(a, b - a).to_pylist()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                                  pa.array([y for _, y in links], pa.int64())], names=["src", "dst"])
        links = flush(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                          pa.array([y for _, y in links], pa.int64())], names=["src", "dst"])
    return pieces.mapInArrow(run, "src long, dst long")


def _sets_of(docs: DataFrame, members: DataFrame, n: int, text: str, **classes) -> DataFrame:
    """The sets of the classes in ``members``, made again from the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, flat, ends, f1 in _each(batches, "text", n, **classes):
            keep = [(c, a, b) for c, a, b in zip(f1.view(np.int64).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
                    if b > a and not (c in seen or seen.add(c))]
            yield pa.RecordBatch.from_arrays([
                pa.array([c for c, _, _ in keep], pa.int64()),
                pa.array([flat[a:b].tobytes() for _, a, b in keep], pa.binary())], names=["cls", "payload"])
    sets = docs.select(F.col(text).alias("text")).mapInArrow(run, "cls long, payload binary")
    few = members.count() <= BROADCAST_ROWS
    return sets.join(F.broadcast(members) if few else members, "cls")


def ngram_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id",
                     text: str = "text", also: list[str] | None = None, class_bits: int = 64) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``num`` / ``den``
    on their distinct word ``n``-grams.

    Returns one row a document: its ``doc_id`` column, the columns named in ``also``,
    ``n_shingles``, ``cls`` (documents with equal sets share it) and ``component_id``:
    the least ``doc_id`` reachable by links.

    Words are runs without white space, A-Z lower-cased; a document of fewer than
    ``n`` words has its whole sequence as its only n-gram.  Null and empty texts
    have an empty set and are linked with nothing, also not with each other.  Null
    ids take part and are never the least, unless there is no other.  Equal sets are one
    class, however many documents have it; copies are not paired.

    1. A pass over the texts gives sizes, signatures and a count sketch of fixed
       size over all tokens.
    2. Sets are grouped by their rarest tokens (a prefix in which linked sets
       always share one); of tokens with the same documents one stays.  A signature
       tree over each group finds which could be linked; their components are
       candidate groups.
    3. The sets of those groups meet, one copy of a set in a group, and a signature tree
       with exact intersections finds the links that connect them.
    Groups above ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` are joined by pairs of blocks.
    Tokens are 64-bit hashes.  Different sets of one 64-bit class are told apart by a
    second fingerprint and get classes of their own; ``class_bits`` under 64 makes such
    clashes likely, to try them.
    """
    also = list(also or [])
    signed = cut_lineage(_signatures(docs, n, doc_id, text, also, class_bits))
    sketch = gather.add_up(signed.filter("part is not null"), 1 << SKETCH_BITS)
    rows = signed.filter("part is null")

    def classes_of(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.filter("n > 0").groupBy("cls").agg(
            F.min("_key").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"),
            (F.min("check") != F.max("check")).alias("_clash")))
    classes, renamed = classes_of(rows), {}
    if not classes.filter("_clash").isEmpty():
        renamed = _renamed(rows, classes)
        names = docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "cls long, check long, _name long")
        rows = rows.join(F.broadcast(names), ["cls", "check"], "left").withColumn("cls", F.coalesce("_name", "cls"))
        classes = classes_of(rows)
    kept = {"class_bits": class_bits, "renamed": renamed}
    prefix = _shared_tokens(_prefixes(docs, n, text, sketch, num, den, **kept))
    h = F.xxhash64("cls")
    posting = prefix.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(h).alias("_x"), F.bit_xor(F.xxhash64(h, F.lit(7))).alias("_y")) \
        .filter("m > 1").groupBy("m", "_x", "_y").agg(F.min("token").alias("gid")).select("gid", "m")
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks")
    grouped = prefix.join(posting, prefix["token"] == posting["gid"]).select("gid", "cls", blocks) \
        .join(classes.select("cls", "n", F.col("sig").alias("payload")), "cls")
    maybe = connected_components(_join_groups(grouped, False, num, den))
    members = maybe.withColumnRenamed("node", "cls").withColumnRenamed("component", "gid") \
        .join(classes.select("cls", "n"), "cls")
    weight = members.groupBy("gid").agg(F.greatest(
        F.ceil(F.sum("n") * 8 / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("blocks"))
    members = cut_lineage(members.join(weight, "gid"))
    links = connected_components(_join_groups(_sets_of(docs, members, n, text, **kept), True, num, den))
    parts = classes.join(links, classes["cls"] == links["node"], "left") \
        .select("cls", "least", F.coalesce("component", "cls").alias("_part"))
    least = parts.groupBy("_part").agg(F.min("least").alias("component_id"))
    named = parts.join(least, "_part").select("cls", "component_id", F.lit(True).alias("_known"))
    out = rows.select("_key", *also, "n", "cls").join(named, "cls", "left")
    return out.select(F.col("_key").alias(doc_id), *also, F.col("n").alias("n_shingles"), "cls",
                      F.when(F.col("_known") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("_key")).alias("component_id"))
