"""Repair of conversation structure: faults of rows, cheapest edits, the repaired text's digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlog.llm import edit_paths as ep
from attemptlog.session import cut_lineage

#: Rows of a conversation that are edited in one piece at most: two to this power.
BLOCK_BITS = 12
#: Rows taken by the numpy kernels at once.
SLICE_ROWS = 1 << 16
SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32("conv_id:turn") % 20``: 0 drops a row (it stays, with ``there``
    false), 1 empties its text, 2 removes ``.``, ``!`` and ``?`` from it, 3 repeats it, 4 makes its role
    ``user``.  Nulls of role, text and in the key are read as one space; a null turn stays null."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    copies = F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), k.alias("_k")) \
        .select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                (F.col("_k") != 0).alias("there"), F.explode(copies).alias("_copy")).drop("_copy")


def _named(rows: DataFrame, there: Column) -> DataFrame:
    """Rows with a key that is never null and a digest that tells role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "conv_id",
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there")) \
        .withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def _code() -> Column:
    """Fault and role initial of a row as one number; ``again`` tells a duplicate."""
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(body == "", ep.BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), ep.CUT).otherwise(ep.NONE)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", ep.SYSTEM).when(initial == "u", ep.USER).when(initial == "a", ep.ASSISTANT).otherwise(ep.OTHER)
    return (fault * 4 + kind).cast("tinyint")


def _pieces(rows: DataFrame) -> DataFrame:
    """One row for every piece of a conversation (key, block) with its rows' codes and turns in order.

    Rows get their places from range partitions over (key, turn, role, digest), written
    once, so that a conversation may lie in many of them; pieces end at multiples of the block size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "turn", "role", "digest", "_tie"]
    narrow = rows.select("key", "conv_id", "turn", "role", "digest", "there", _code().alias("code"),
                         F.monotonically_increasing_id().alias("_tie"))
    placed = cut_lineage(narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .select("key", "conv_id", "turn", "digest", "there", "code", F.monotonically_increasing_id().alias("pos")))
    said = F.col("there") & (F.shiftright("code", 2) != ep.BLANK)
    again = placed.filter(said).groupBy("key", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").select("key", "digest", "first")
    code = F.when(said & (F.col("pos") > F.col("first")), (ep.DUPLICATE * 4 + F.col("code") % 4).cast("tinyint")).otherwise(F.col("code"))
    coded = placed.join(again, ["key", "digest"], "left")
    row = F.when(F.col("there"), F.struct("pos", "turn", code.alias("code")))
    return coded.groupBy("key", F.shiftright("pos", BLOCK_BITS).alias("block")) \
        .agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(row)).alias("rows")) \
        .select("key", "block", "conv_id", F.col("rows.code").alias("codes"), F.col("rows.turn").alias("turns"))


_SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, first int, last int, " \
           "low long, high long, turns_seen long, turn_first long, turn_last long, matrix binary, cost long"


def _summaries(pieces: DataFrame) -> DataFrame:
    """Pieces with the counts of their rows and the least cost from each state to each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, ends in _slices(batch.column("codes")):
                part = batch.slice(lo, hi - lo)
                starts = np.concatenate([[0], ends[:-1]])
                fault, kind = codes >> 2, codes & 3

                def count(flag: np.ndarray, a=starts, b=ends) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(flag)])
                    return total[b] - total[a]
                legal = np.isin(kind[:-1] * 4 + kind[1:], [ep.SYSTEM * 4 + ep.USER, ep.USER * 4 + ep.ASSISTANT, ep.ASSISTANT * 4 + ep.USER])
                pairs = np.concatenate([~legal, [False]]) if len(kind) else np.zeros(0, bool)
                pairs[ends[(ends > starts)] - 1] = False       # a pair does not reach over pieces
                some = ends > starts
                edge = [np.where(some, kind[np.minimum(at, max(len(kind) - 1, 0))], -1) if len(kind) else np.full(len(ends), -1)
                        for at in (starts, np.maximum(ends - 1, 0))]
                told = [_turns(t) for t in part.column("turns").to_pylist()]
                matrix = ep.matrices(codes, ends)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("block"), part.column("conv_id"), part.column("codes"),
                     pa.array(ends - starts), *[pa.array(count(fault == f)) for f in (ep.BLANK, ep.DUPLICATE, ep.CUT)],
                     pa.array(count(pairs)), *[pa.array(e.astype(np.int32)) for e in edge],
                     *[pa.array([t[k] for t in told], pa.int64()) for k in range(5)],
                     pa.array([m.tobytes() for m in matrix], pa.binary()),
                     pa.array(ep.through(matrix, np.broadcast_to(ep.END, (len(matrix), 4)))[:, 0])], names=out.names)
    out = T.StructType([f for f in pieces.schema.fields if f.name != "turns"])
    for f in T._parse_datatype_string(_SUMMARY).fields:
        out = out.add(f)
    return pieces.mapInArrow(run, out)


def _turns(turns: list) -> tuple:
    """Least, greatest, number of different, first and last of the turns that are not null."""
    known = [t for t in turns if t is not None]
    if not known:
        return None, None, 0, None, None
    return known[0], known[-1], len(set(known)), known[0], known[-1]


def _slices(codes: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` of a column of code lists with the codes end to end and their ends."""
    size = codes.value_lengths().to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    while lo < len(size):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + SLICE_ROWS, "right")))
        hi = min(hi, lo + SLICE_ROWS)
        yield lo, hi, flat[before:int(upto[hi - 1])], upto[lo:hi] - before
        lo = hi


_WHOLE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _whole(parts: list[dict]) -> tuple[dict, list[np.ndarray]]:
    """Counts and cost of a conversation from its pieces in order, and the costs to come to an end behind each."""
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    full = [p for p in parts if p["n"]]
    for a, b in zip(full, full[1:], strict=False):
        out["illegal"] += (a["last"], b["first"]) not in ((ep.SYSTEM, ep.USER), (ep.USER, ep.ASSISTANT), (ep.ASSISTANT, ep.USER))
    timed = [p for p in full if p["turns_seen"]]
    seen = sum(p["turns_seen"] for p in timed) - sum(a["turn_last"] == b["turn_first"] for a, b in zip(timed, timed[1:], strict=False))
    out["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - seen if timed else 0
    after, costs = ep.END, []
    for p in reversed(parts):
        costs.append(after)
        after = ep.through(np.frombuffer(p["matrix"], np.int64).reshape(4, 4), after)
    out["cost"] = int(after[0])
    return out, costs[::-1]


def _spanning(pieces: DataFrame) -> DataFrame:
    """Counts of the conversations of several pieces, once for each piece with the costs behind it.
    Only the summaries of a conversation meet in one row, one for every block of rows."""
    several = pieces.drop("codes", "conv_id").groupBy("key") \
        .agg(F.sort_array(F.collect_list(F.struct("block", *[c for c in pieces.columns if c not in ("key", "block", "codes", "conv_id")]))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in names}
            for key, parts in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                whole, after = _whole(parts)
                for p, a in zip(parts, after, strict=True):
                    rows["key"].append(key)
                    rows["block"].append(p["block"])
                    rows["after"].append(a.tobytes())
                    rows["last"].append(p is parts[-1])
                    for c in counts:
                        rows[c].append(whole[c])
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], kinds[c]) for c in names], names=names)
    counts = [f.name for f in T._parse_datatype_string(_WHOLE).fields]
    names = ["key", "block", "after", "last", *counts]
    kinds = {"key": pa.string(), "block": pa.int64(), "after": pa.binary(), "last": pa.bool_(), **{c: pa.int64() for c in counts}}
    return several.mapInArrow(run, f"key string, block long, after binary, last boolean, {_WHOLE}")


def _audits(pieces: DataFrame) -> DataFrame:
    """Letters of each piece's least audit from every state in which it may be entered (a whole
    conversation only from the start), and the states behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, ends in _slices(batch.column("codes")):
                part = batch.slice(lo, hi - lo)
                after = np.frombuffer(b"".join(part.column("after").to_pylist()), np.int64).reshape(-1, 4)
                last = part.column("last").to_numpy(zero_copy_only=False).astype(bool)
                alone = part.column("alone").to_numpy(zero_copy_only=False).astype(bool)
                ways = np.where(alone, 1, 4)
                upto = np.cumsum(ways)
                entries = np.stack([np.repeat(np.arange(len(ways)), ways), np.arange(int(upto[-1])) - np.repeat(upto - ways, ways)], 1)
                letters, ended, state = ep.least_audits(codes, ends, after, last, entries)
                text = bytes(letters).decode("ascii")
                cuts = [0, *ended.tolist()]
                audits = pa.array([text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())
                at = pa.array(np.concatenate([[0], upto]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.ListArray.from_arrays(at, audits),
                     pa.ListArray.from_arrays(at, pa.array(state.astype(np.int32)))], names=out.names)
    kept = [c for c in pieces.columns if c not in ("codes", "after", "last", "alone")]
    out = T.StructType([f for f in pieces.schema.fields if f.name in kept]) \
        .add("audits", T.ArrayType(T.StringType())).add("states", T.ArrayType(T.IntegerType()))
    return pieces.mapInArrow(run, out)


def _chained(pieces: DataFrame, counts: list[str]) -> DataFrame:
    """The audit of conversations of several pieces: each is entered in the state behind the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits = []
            for parts in batch.column("parts").to_pylist():
                state, told = 0, []
                for p in parts:
                    told.append(p["audits"][state])
                    state = p["states"][state]
                audits.append("".join(told))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "conv_id", *counts)], pa.array(audits, pa.string())],
                                             names=["key", "conv_id", *counts, "audit"])
    grouped = pieces.groupBy("key").agg(F.first("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in counts],
                                        F.sort_array(F.collect_list(F.struct("block", "audits", "states"))).alias("parts"))
    out = T.StructType([f for f in grouped.schema.fields if f.name != "parts"]).add("audit", T.StringType())
    return grouped.mapInArrow(run, out)


def _digests(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Audits with the sha256 of the repaired lines.  A conversation's audit and then its rows in
    order stream through one task, which holds a batch, the audit and the digest's state: a
    sha256 takes its text from front to back."""
    stream = audits.select(F.lit(0).alias("kind"), *audits.columns, *[F.lit(None).cast(t).alias(c) for c, t in (
        ("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))]).unionByName(
        rows.filter("there").select(F.lit(1).alias("kind"), "key", "turn", "role", "digest", "text"), allowMissingColumns=True)
    stream = stream.repartition("key").sortWithinPartitions("key", "kind", "turn", "role", "digest").drop("turn", "digest")
    kept = [c for c in audits.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None             # the conversation that is not yet complete
        audit, at, state, sha, line = "", 0, 0, None, False
        turn = {0: "user", 1: "user", 2: "assistant", 3: "user"}

        def say(role: str, text: str) -> None:
            nonlocal state, line
            sha.update(f"\n{role}:{text}".encode() if line else f"{role}:{text}".encode())
            line = True
            state = {"s": 1, "u": 2, "a": 3}[role[0]]

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                say(turn[state], "")
                at += 1

        def told(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.concat_arrays([d[0].column(c) for d in done]) for c in kept], pa.array([d[1] for d in done], pa.string())],
                names=[*kept, "repaired_sha256"])
        for batch in batches:
            done = []
            kinds = batch.column("kind").to_numpy()
            roles, texts = batch.column("role"), batch.column("text")
            for k in range(len(kinds)):
                if kinds[k] == 0:
                    if held is not None:
                        inserted()
                        done.append((held, sha.hexdigest()))
                    held = batch.slice(k, 1).select(kept)
                    audit, at, state, sha, line = held.column("audit")[0].as_py(), 0, 0, hashlib.sha256(), False
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    say(roles[k].as_py(), texts[k].as_py())
                elif edit == "R":
                    say(turn[state], texts[k].as_py())
            if done:
                yield told(done)
        if held is not None:
            inserted()
            yield told([(held, sha.hexdigest())])
    out = T.StructType([f for f in audits.schema.fields if f.name in kept]).add("repaired_sha256", T.StringType())
    return stream.mapInArrow(run, out)


def repair_conversations(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text).

    A conversation's rows are taken by turn, nulls first; rows of equal turn by role and then by
    digest of role and text, so equal rows stand together.  Null roles and texts are read as one
    space.  A row's first fault counts: blank (nothing but white space), duplicate (role and text of an
    earlier row), truncated (the last character that is not white space is none of ``.!?``).
    Edits: Keep, Rerole, Delete, Insert with the costs of :mod:`edit_paths`; roles must
    come to read ``(s?(ua)+)?`` by their initials, so a role with another or no initial cannot be kept.

    Returns one row a conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``.  A null conv_id is a conversation of
    its own.  Rows where ``there`` is false are left out; a conversation without others gives zeros, an
    empty audit and the digest of the empty text.  An empty table gives an empty result.  Further columns
    are not read.

    Rows are put in order by range partitions and cut into pieces of at most 2 ** BLOCK_BITS rows, so
    a conversation of any length is spread.  A piece's cost matrix and then its least audits from
    each state are made alone; only these summaries of one conversation meet in a row.  The text
    is shuffled once, for the digest, which has to be taken in order by one task a conversation.
    """
    named = _named(rows, F.lit(True) if there is None else there)
    pieces = cut_lineage(_summaries(_pieces(named)))
    several = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("key")
    several = cut_lineage(several)
    counts = [f.name for f in T._parse_datatype_string(_WHOLE).fields]
    timed = F.when(F.col("turns_seen") > 0, F.col("high") - F.col("low") + 1 - F.col("turns_seen")).otherwise(0)
    whole = pieces.join(several, "key", "left_anti").select(
        "key", "conv_id", "codes", F.lit(bytearray(ep.END.tobytes())).alias("after"), F.lit(True).alias("last"),
        F.lit(True).alias("alone"), timed.cast("long").alias("gaps"), *counts[1:])
    one = _audits(whole).select("key", "conv_id", *counts, F.col("audits")[0].alias("audit"))
    spread = pieces.join(several, "key", "left_semi")
    cut = spread.select("key", "block", "conv_id", "codes").join(_spanning(spread.drop("cost")), ["key", "block"])
    many = _chained(_audits(cut.withColumn("alone", F.lit(False))), counts)
    out = _digests(one.unionByName(many), named)
    return out.select("conv_id", *counts, "audit", "repaired_sha256")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """:func:`repair_conversations` of rows after :func:`damage`."""
    hurt = damage(rows)
    return repair_conversations(hurt, F.col("there"))
