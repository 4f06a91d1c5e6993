"""Sequence encodings of histories.

Array work stays in higher-order functions; id -> index lookups are joins on
exploded positions against a vocabulary table (built with the skew-safe
``global_rank``), never a driver-side dict.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlog.functions.textfn import split_paths
from attemptlog.operators.splits import global_rank

PAD = 0          # padding / END index
UNK = 1          # unknown token index (path vocabularies)
TOKEN_SHARE = 1024   # a token of more than one in this many is looked up in a map, not by shuffle


def task_vocabulary(targets: DataFrame, histories: DataFrame, target: str = "new_task_id",
                    hist: str = "prev_tasks_id", start: int = 1) -> DataFrame:
    """W9 + U4: index over target ids union history ids, sorted, from ``start``
    (1 by default so that 0 is only padding, Q34)."""
    a = targets.select(F.col(target).cast("string").alias("task_id"))
    b = histories.select(F.explode(hist).alias("task_id")).select(F.col("task_id").cast("string"))
    ids = a.union(b).distinct()
    r = global_rank(ids, ["task_id"], out="task_index")
    return r.withColumn("task_index", F.col("task_index") + start)


def map_array(df: DataFrame, row_key: Sequence[str], col: str, vocab: DataFrame,
              key: str = "task_id", value: str = "task_index", out: str | None = None,
              default: int | None = None) -> DataFrame:
    """Array of keys -> array of vocabulary values, by position (unknown ->
    ``default``).  One collect per row, bounded by the array length."""
    row_key = list(row_key)
    ex = df.select(*row_key, F.posexplode(col).alias("_p", "_k"))
    v = vocab.select(F.col(key).cast("string").alias("_k"), F.col(value).alias("_v"))
    j = ex.join(v, ex["_k"].cast("string") == v["_k"], "left").drop(v["_k"])
    val = F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")
    back = j.groupBy(*row_key).agg(F.sort_array(F.collect_list(F.struct("_p", val.alias("_v")))).alias("_s"))
    back = back.select(*row_key, F.transform("_s", lambda x: x["_v"]).alias(out or col + "_idx"))
    return df.join(back, row_key, "left")


def snapshots_per_task(prev_scores: str = "prev_scores") -> Column:
    """number of snapshots of each history task."""
    return F.transform(prev_scores, lambda x: F.size(x))


def encode_tasks(df: DataFrame, q: str = "prev_q", labels: str = "prev_labels") -> DataFrame:
    """Task sequence with one label per task (labels as 0/1)."""
    return df.withColumn("task_seq", F.col(q)) \
             .withColumn("label_seq", F.transform(labels, lambda x: x.cast("int")))


def right_pad(c: Column, n: int, value=0) -> Column:
    return F.slice(F.concat(c, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(c), F.lit(0)))), 1, n)


def left_pad_last(c: Column, n: int, value=0) -> Column:
    """Keep the last ``n`` entries and left-pad with ``value`` to length ``n``."""
    kept = F.slice(c, F.greatest(F.size(c) - n, F.lit(0)) + 1, n)
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(kept), F.lit(0))), kept)


def encode_attempts(df: DataFrame, pad: int = 765, q: str = "prev_q", labels: str = "prev_labels",
                    prev_scores: str = "prev_scores") -> DataFrame:
    """Task index repeated once per snapshot; the label sits on the last
    snapshot of a task (0 elsewhere); right-padded with 0 to ``pad``."""
    z = F.arrays_zip(F.col(q).alias("q"), F.col(labels).alias("l"), snapshots_per_task(prev_scores).alias("n"))
    qs = F.flatten(F.transform(z, lambda x: F.array_repeat(x["q"], x["n"])))
    ls = F.flatten(F.transform(z, lambda x: F.concat(
        F.array_repeat(F.lit(0), x["n"] - 1), F.array(x["l"].cast("int")))))
    return df.withColumn("attempt_q", right_pad(qs, pad)).withColumn("attempt_labels", right_pad(ls, pad))


def encode_interactions(df: DataFrame, n_tasks: int | Column, length: int = 100, q: str = "prev_q",
                        labels: str = "prev_labels", per_attempt: bool = False,
                        prev_scores: str = "prev_scores", out: str = "interactions") -> DataFrame:
    """Interaction code q when the label is true, q + N otherwise; keep
    the last ``length`` and left-pad with 0.  With ``per_attempt`` every
    snapshot but the last of a task counts as q + N."""
    N = F.lit(n_tasks) if isinstance(n_tasks, int) else n_tasks
    if per_attempt:
        z = F.arrays_zip(F.col(q).alias("q"), F.col(labels).alias("l"),
                         snapshots_per_task(prev_scores).alias("n"))
        codes = F.flatten(F.transform(z, lambda x: F.concat(
            F.array_repeat(x["q"] + N, x["n"] - 1),
            F.array(F.when(x["l"], x["q"]).otherwise(x["q"] + N)))))
    else:
        codes = F.zip_with(q, labels, lambda a, b: F.when(b, a).otherwise(a + N))
    return df.withColumn(out, left_pad_last(codes, length))


def positions(df: DataFrame, col: str = "interactions", out: str = "positions") -> DataFrame:
    """0-based positions of the non-padding entries."""
    idx = F.transform(col, lambda x, i: F.when(x != PAD, i).otherwise(F.lit(-1)))
    return df.withColumn(out, F.filter(idx, lambda p: p >= 0))


def decode_interactions(df: DataFrame, n_tasks: int | Column, col: str = "interactions",
                        target: str = "target_q", out: str = "decoded") -> DataFrame:
    """Interaction code -> task index (subtract N above N; padding stays 0),
    then shift by one with the target appended (the next-task sequence)."""
    N = F.lit(n_tasks) if isinstance(n_tasks, int) else n_tasks
    q = F.transform(col, lambda c: F.when(c > N, c - N).otherwise(c))
    shifted = F.concat(F.slice(q, 2, F.size(q) - 1), F.array(F.col(target)))
    return df.withColumn(out, q).withColumn(out + "_shifted", shifted)


def one_hot_target(df: DataFrame, n_tasks: int | Column, col: str = "target_q", out: str = "target_one_hot") -> DataFrame:
    """One-hot vector of the target index (length ``n_tasks + 1``, slot 0 = padding)."""
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(n_tasks).cast("int") if isinstance(n_tasks, int)
                                                     else n_tasks.cast("int")),
                                          lambda i: (i == F.col(col)).cast("int")))


# ---------------------------------------------------------------------------
# code paths
# ---------------------------------------------------------------------------


def path_entries(paths: DataFrame, key: Sequence[str], col: str = "RawASTPath",
                 max_paths: int | None = None, min_entry: int = 0) -> DataFrame:
    """one row per (key, entry position) with start, path, end.  Entries whose
    trimmed text is no longer than ``min_entry`` are left out."""
    key = list(key)
    arr = split_paths(col, min_entry=min_entry)
    if max_paths:
        arr = F.slice(arr, 1, max_paths)
    return paths.select(*key, F.posexplode(arr).alias("entry", "e")) \
                .select(*key, "entry", "e.start", "e.path", "e.end")


def path_vocabulary(paths: DataFrame, key: Sequence[str], train_ids: DataFrame | None = None,
                    student: str = "student_id", col: str = "RawASTPath") -> tuple[DataFrame, DataFrame]:
    """A30 + F26: node and path vocabularies from training students only.

    Entries (not tokens) of trimmed length <= 3 are left out; every token of the
    others counts.  ``paths`` has one row per distinct code, so a code counts
    once, however often it is used.  Indices start at 2 (0 = END, 1 = UNK),
    ordered by count desc, then token."""
    p = paths if train_ids is None else paths.join(train_ids.select(student), student, "left_semi")
    e = path_entries(p, list(key), col, min_entry=3)
    nodes = e.select(F.explode(F.array("start", "end")).alias("token"))
    pth = e.select(F.col("path").alias("token"))

    def vocab(t: DataFrame) -> DataFrame:
        c = t.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
        c = c.withColumn("_neg", -F.col("count"))
        r = global_rank(c, ["_neg", "token"], out="index")
        return r.withColumn("index", F.col("index") + 2).drop("_neg")
    return vocab(nodes), vocab(pth)


def mark_frequent(tokens: DataFrame, vocab: DataFrame, share: int = TOKEN_SHARE) -> DataFrame:
    """Add the index of the frequent tokens of ``tokens`` (``kind``, ``token``) and a
    key ``_t``, ``_s`` to join the others by.

    Frequent is what makes up more than one in ``share`` of all rows, known to
    ``vocab`` (``kind``, ``token``, ``index``) or not: fewer than ``share`` tokens, so
    their digests and indices are broadcast.  The rows of frequent tokens get
    ``_index`` (UNK if unknown), a null ``_t`` and spread ``_s``; no key of the
    others has more than that share of rows.  Null tokens are unknown ones.
    """
    counts = tokens.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    often = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * share > F.col("_all")).select("kind", "token") \
        .join(vocab, ["kind", "token"], "left") \
        .select(F.col("kind").alias("_kind"), F.md5(F.coalesce("token", F.lit(""))).alias("_d"),
                F.coalesce("index", F.lit(UNK)).cast("long").alias("_index"), F.col("token").isNull().alias("_null"))
    digest = F.md5(F.coalesce("token", F.lit("")))
    hot = F.col("_index").isNotNull()
    return tokens.join(F.broadcast(often), (F.col("kind") == F.col("_kind")) & (digest == F.col("_d"))
                       & (F.col("token").isNull() == F.col("_null")), "left") \
        .withColumn("_t", F.when(~hot, F.col("token"))) \
        .withColumn("_s", F.when(hot, F.pmod(F.xxhash64(*[c for c in tokens.columns if c not in ("kind", "token")]), F.lit(share)))
                    .otherwise(0).cast("int")) \
        .drop("_kind", "_d", "_null")


def encode_code_steps(paths: DataFrame, node_vocab: DataFrame, path_vocab: DataFrame,
                      key: Sequence[str], max_paths: int = 100, col: str = "RawASTPath") -> DataFrame:
    """K19 (long form): per step, the first ``max_paths`` entries as (start,
    path, end) indices; unknown -> UNK, missing entries padded with END.

    Tokens of all three fields go through one join: the frequent ones by a
    bounded map, the rest by shuffle (:func:`mark_frequent`)."""
    key = list(key)
    fields = ("start", "path", "end")
    kind = {"start": 0, "path": 1, "end": 0}
    tokens = path_entries(paths, key, col, max_paths).select(*key, "entry", F.explode(F.array(*[
        F.struct(F.lit(k).alias("field"), F.lit(kind[f]).alias("kind"), F.col(f).alias("token"))
        for k, f in enumerate(fields)])).alias("_x")).select(*key, "entry", "_x.field", "_x.kind", "_x.token")
    vocab = node_vocab.select(F.lit(0).alias("kind"), "token", "index") \
        .unionByName(path_vocab.select(F.lit(1).alias("kind"), "token", "index"))
    known = vocab.select("kind", F.col("token").alias("_t"), F.lit(0).alias("_s"), F.col("index").alias("_known"))
    e = mark_frequent(tokens, vocab).join(known, ["kind", "_t", "_s"], "left")
    g = e.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "entry", "field", F.coalesce("_index", "_known", F.lit(UNK)).alias("i")))).alias("_e"))
    out = paths.select(*key).join(g, key, "left")

    def of(k: int) -> Column:
        mine = F.transform(F.filter("_e", lambda x: x["field"] == k), lambda x: x["i"])
        return right_pad(F.coalesce(mine, F.array().cast("array<long>")), max_paths, PAD)
    return out.select(*key, *[of(k).alias(f"{f}_idx") for k, f in enumerate(fields)])


def code_step_rows(df: DataFrame, row_key: Sequence[str], n_tasks: int | Column, length: int = 100,
                   q: str = "prev_q", labels: str = "prev_labels", codes: str = "prev_tasks") -> DataFrame:
    """K19 (long form): the last ``length`` attempts of each row's history as steps.

    One row per (row, ``step``): ``step`` counts from 0 in a sequence left-padded
    to ``length`` (padding steps have no row), ``interaction`` is the place of the
    1 in the 2N interaction part (q when the task's label is true and the attempt is
    its last, q + N otherwise) and ``code`` the attempt's snapshot, whose path
    indices (:func:`encode_code_steps`, once per snippet) join on it."""
    N = F.lit(n_tasks) if isinstance(n_tasks, int) else n_tasks
    z = F.arrays_zip(F.col(q).alias("q"), F.col(labels).alias("l"), F.col(codes).alias("c"))
    steps = F.flatten(F.transform(z, lambda x: F.transform(x["c"], lambda c, i: F.struct(
        F.when(x["l"] & (i == F.size(x["c"]) - 1), x["q"]).otherwise(x["q"] + N).alias("interaction"), c.alias("code")))))
    kept = F.slice(steps, F.greatest(F.size(steps) - length, F.lit(0)) + 1, length)
    ex = df.select(*row_key, kept.alias("_s")).select(*row_key, F.size("_s").alias("_n"), F.posexplode("_s").alias("_i", "_x"))
    return ex.select(*row_key, (F.col("_i") + length - F.col("_n")).cast("long").alias("step"), "_x.interaction", "_x.code")


def training_examples(df: DataFrame, row_key: Sequence[str], n_tasks: int = 30,
                      labels: str = "prev_labels", prev_scores: str = "prev_scores") -> DataFrame:
    """K13 (fixed-shape part): snapshots per task padded with 1, task count
    (unpadded length, Q24) and labels padded with False to ``n_tasks``."""
    return df.select(
        *row_key,
        right_pad(snapshots_per_task(prev_scores), n_tasks, 1).alias("snaps_per_task"),
        F.size(labels).alias("task_num"),
        right_pad(F.transform(labels, lambda x: x.cast("int")), n_tasks, 0).alias("labels_padded"))
