"""SimHash near duplicates by multi-index hashing of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlog.llm import tokens
from attemptlog.llm.graph import connected_components
from attemptlog.llm.hot import attach
from attemptlog.llm.xxh import xxh64
from attemptlog.session import cut_lineage

#: Differing bits of linked fingerprints.  The segments' balls below hold for this many.
RADIUS = 2
#: A table bucket of more fingerprints is linked through balls of whole fingerprints.
BUCKET = 64
#: Shingles counted at once in 16-bit counters.
RUN = 60_000
_LANES = np.zeros(16, np.uint64)         # the four bits of a half byte, each in 16 bits of its own
for _k in range(16):
    _LANES[_k] = sum(((_k >> _b) & 1) << (16 * _b) for _b in range(4))


def _close_up(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end with one space behind each, and their starts and ends there."""
    size = e - s + 1
    ends = np.cumsum(size)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(s - (ends - size), size)
    out = np.zeros(len(take) + 8, np.uint8)
    out[:len(take)] = data[take]
    out[ends - 1] = 32
    return out, ends - size, ends - 1


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int = 3) -> np.ndarray:
    """64-bit SimHash of each row over its word ``n``-grams, repeats included: a bit is set
    where over half the XXH64 values have it.  Rows of fewer words have their whole
    sequence as only shingle, rows without words the fingerprint zero."""
    s, e, first = tokens.word_spans(data, offsets, tokens.NOT_SPACE)
    closed, s, e = _close_up(data, s, e)
    words = np.diff(first)
    shingles = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    ends = np.cumsum(shingles)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(first[:-1] - (ends - shingles), shingles)
    h = xxh64(closed, s[at], e[at + np.repeat(np.minimum(np.maximum(words, 1), n) - 1, shingles)])
    # runs of one row, short enough for the counters
    cuts = np.unique(np.concatenate([ends - shingles, np.arange(0, total, RUN)]))
    cuts = cuts[cuts < total]
    out = np.zeros(len(words), np.uint64)
    if not total:
        return out
    row = np.searchsorted(ends, cuts, "right")
    for half in range(16):
        lanes = np.add.reduceat(_LANES[(h >> np.uint64(4 * half)).astype(np.uint8) & 15], cuts)
        for b in range(4):
            count = np.zeros(len(words), np.int64)
            np.add.at(count, row, ((lanes >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (2 * count > shingles).astype(np.uint64) << np.uint64(4 * half + b)
    return out


def with_fingerprints(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``_key`` (its ``doc_id``) and ``fp``, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tokens.slices(batch.column("_text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(lo, hi - lo), pa.array(fingerprints(data, offsets, n).view(np.int64))],
                    names=["_key", "fp"])
    rows = docs.select(F.col(doc_id).alias("_key"), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _upward_ball(half: Column) -> Column:
    """The value and every value with one more of its 32 bits set.  Of two values that
    differ in one bit, one has the other in its upward ball."""
    return F.concat(F.array(half), F.filter(
        F.array(*[F.when(half.bitwiseAND(1 << b) == 0, half.bitwiseOR(F.lit(1 << b).cast("long"))) for b in range(32)]),
        lambda v: v.isNotNull()))


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def near_pairs(prints: DataFrame) -> DataFrame:
    """Edges ``src``, ``dst`` that connect the distinct fingerprints (column ``fp``) as all
    pairs within ``RADIUS`` bits do.

    Two tables are keyed by the low and the high 32 bits.  Of two fingerprints within two
    bits either the low halves differ in one bit at most, or the high halves are equal:
    the table of low halves is probed with the ball of radius one, that of high halves with
    the value, and whole distances are verified.

    A bucket of more than ``BUCKET`` fingerprints is not paired.  All that are in it or probe
    it list the ball of radius one around their whole fingerprint (65 values) instead:
    two fingerprints within two bits have a value of their balls in common, and two that
    have one are within two bits, so each is linked to the least that lists the value.
    """
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    table = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("v")),
                                                  F.struct(F.lit(1).alias("seg"), high.alias("v")))).alias("t")) \
        .select("t.seg", "t.v", "fp")
    probes = prints.select(F.lit(0).alias("seg"), F.explode(_upward_ball(low)).alias("v"), F.col("fp").alias("by")) \
        .unionByName(prints.select(F.lit(1).alias("seg"), high.alias("v"), F.col("fp").alias("by")))
    hot = cut_lineage(table.groupBy("seg", "v").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > BUCKET).select("seg", "v"))
    if hot.isEmpty():
        return _matches(table, probes)
    members = table.join(hot, ["seg", "v"], "left_semi").select("fp") \
        .unionByName(probes.join(hot, ["seg", "v"], "left_semi").select(F.col("by").alias("fp"))).distinct()
    ball = F.explode(F.concat(F.array("fp"), F.array(*[
        F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long")) for b in range(64)]))).alias("z")
    listed = cut_lineage(members.select("fp", ball))
    least = listed.groupBy("z").agg(F.min("fp").alias("src"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("z", "src")
    through = listed.join(least, "z").filter(F.col("src") != F.col("fp")).select("src", F.col("fp").alias("dst")).distinct()
    return _matches(table.join(hot, ["seg", "v"], "left_anti"), probes).unionByName(through)


def _matches(table: DataFrame, probes: DataFrame) -> DataFrame:
    found = table.join(probes, ["seg", "v"]).filter((F.col("fp") != F.col("by")) & _near(F.col("fp"), F.col("by")))
    return found.select(F.col("fp").alias("src"), F.col("by").alias("dst"))


def simhash_components(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents linked by SimHash fingerprints of at most ``RADIUS`` differing bits.

    Returns one row a document: its ``doc_id`` column, ``fp`` (signed long), ``fingerprint``
    (16 lowercase hex digits) and ``component_id``, the least ``doc_id`` reachable by links.

    A-Z is lower-cased; words are runs without white space; shingles are ``n`` words joined
    by one space, repeats counted, hashed by XXH64 with seed 42.  Fewer words: the whole
    sequence.  Null, empty and blank texts have the fingerprint zero and are linked like
    any other.  A null id is never the least unless a group has no other.  Repeated rows
    are kept; an empty table gives an empty result.  Further columns are not read.

    Documents of one fingerprint are one node, however many they are; only distinct
    fingerprints are looked up (:func:`near_pairs`).
    """
    signed = cut_lineage(with_fingerprints(docs, n, doc_id, text))
    kinds = cut_lineage(signed.groupBy("fp").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("k")))
    parts = connected_components(near_pairs(kinds.select("fp")))
    inside = kinds.join(parts, kinds["fp"] == parts["node"], "left") \
        .select("fp", "k", "least", F.coalesce("component", "fp").alias("part"))
    named = inside.join(inside.groupBy("part").agg(F.min("least").alias("component_id")), "part") \
        .select("fp", "k", "component_id")
    out = attach(signed, named, "fp", "k")
    return out.select(F.col("_key").alias(doc_id), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
