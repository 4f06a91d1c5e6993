"""Skew-safe ordered sequences.

Almost every operator in this library needs, for each attempt, its position
inside its (student, problem) group, the previous attempt, the first/last
attempt and the first position of the best score.  The obvious plan -- a window
``PARTITION BY key ORDER BY ord`` -- puts a whole group into one task, so a hot
group holding a third of all rows would run in a single task.

``sequenced`` computes the same values with bounded tasks:

0. hot keys (more than ``target_rows`` attempts) are found with a grouped count;
   that table has at most ``rows / target_rows`` entries, so broadcasting it is
   bounded by construction.  A caller that knows its keys to be bounded, or has
   the hot keys already, passes that and no count runs.
1. rows of hot keys get their exact rank in the full order of their key
   (:func:`attemptlog.operators.splits.global_rank`); a segment is
   ``target_rows`` consecutive ranks, whatever the order values are (equal,
   clustered or NULL).
2. a window over ``(key, seg)`` gives the previous row inside a segment.
3. a per-(key, seg) aggregate (same partitioning, no extra shuffle) gives the
   segment's first/last row and its best score.
4. a window over ``key`` ordered by ``seg`` runs on that segment table (one row
   per segment) and gives the previous segment's last row and the group-level
   first/last/best.
5. the segment table joins back on ``(key, seg)``; the attempt rows are already
   hash-partitioned on exactly those columns, so only the segment table moves.

Results are exact: segmentation only decides which rows share a task.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlog.operators.splits import global_rank

# Attempts per segment above which a key counts as hot and is split.
TARGET_ROWS = 1 << 22


def hot_keys(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """Keys with more than ``target_rows`` rows, with their row count.

    A grouped count over the key columns alone (combined map-side); the result
    has at most ``rows / target_rows`` entries, which bounds its broadcast."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > target_rows)


def _plain(df: DataFrame, keys, order, carry, value) -> DataFrame:
    # one keyed window: a single shuffle of the rows, groups of at most target_rows
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {"pos": F.row_number().over(w).cast("long"),
            "n": F.count(F.lit(1)).over(whole).cast("long")}
    for c in carry:
        cols[f"prev_{c}"] = F.lag(c).over(w)
        cols[f"first_{c}"] = F.first(c).over(whole)
        cols[f"last_{c}"] = F.last(c).over(whole)
    if value:
        cols["best"] = F.max(value).over(whole)
    x = df.withColumns(cols)
    if value:
        x = x.withColumn("best_pos", F.min(F.when(F.col(value) == F.col("best"), F.col("pos")))
                         .over(whole).cast("long"))
    return x


def _segmented(x: DataFrame, keys, order, carry, value) -> DataFrame:
    # rows carry ``n``, ``pos`` and ``_seg``; see the module docstring, steps 2-5
    if not carry and not value:
        return x.drop("_seg")
    lw = Window.partitionBy(*keys, "_seg").orderBy("pos")
    for c in carry:
        x = x.withColumn(f"_lprev_{c}", F.lag(c).over(lw))
    x = x.withColumn("_lpos", F.row_number().over(lw))

    aggs = []
    if carry:
        carry_struct = F.struct(*[F.col(c) for c in carry])
        aggs += [F.min_by(carry_struct, F.col("pos")).alias("_sfirst"),
                 F.max_by(carry_struct, F.col("pos")).alias("_slast")]
    if value:
        aggs += [F.max(value).alias("_sbest"),
                 F.max_by(F.col("pos"), F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col("pos"))))
                 .alias("_sbest_pos")]
    segs = x.groupBy(*keys, "_seg").agg(*aggs)

    kw = Window.partitionBy(*keys)
    if carry:
        segs = (segs.withColumn("_pprev", F.lag("_slast").over(kw.orderBy("_seg")))
                    .withColumn("_gfirst", F.min_by("_sfirst", "_seg").over(kw))
                    .withColumn("_glast", F.max_by("_slast", "_seg").over(kw)))
    if value:
        segs = segs.withColumn("best", F.max("_sbest").over(kw))
        segs = segs.withColumn("best_pos", F.min(F.when(F.col("_sbest") == F.col("best"), F.col("_sbest_pos")))
                               .over(kw).cast("long"))
    segs = segs.drop("_sfirst", "_slast", "_sbest", "_sbest_pos")

    out = x.join(segs, keys + ["_seg"], "inner")
    for c in carry:
        out = out.withColumn(
            f"prev_{c}",
            F.when(F.col("_lpos") == 1, F.col("_pprev")[c]).otherwise(F.col(f"_lprev_{c}")))
        out = out.withColumn(f"first_{c}", F.col("_gfirst")[c]) \
                 .withColumn(f"last_{c}", F.col("_glast")[c])
    return out.drop("_seg", "_lpos", "_pprev", "_gfirst", "_glast", *[f"_lprev_{c}" for c in carry])


def sequenced(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              carry: Iterable[str] = (), value: str | None = None,
              target_rows: int = TARGET_ROWS, detect_hot: bool = True,
              hot: DataFrame | None = None) -> DataFrame:
    """Add sequence columns to flat attempt rows.

    Adds ``pos`` (1-based), ``n`` (group size), ``prev_<c>`` (value of ``c`` on
    the previous attempt, NULL on the first), ``first_<c>`` / ``last_<c>`` (on
    the group's first/last attempt) for every ``c`` in ``carry``; with
    ``value`` also ``best`` (group max) and ``best_pos`` (first position where
    it occurs; NULL if every value is NULL).  ``order`` must be unique within a
    key (end it in a tiebreak); NULLs come first.  Rows with a NULL key are
    dropped (pandas group-by semantics, Q1).

    Ordinary keys take one keyed window; keys with more than ``target_rows``
    rows are split into segments of that many ranks (exact, bounded tasks).
    The hot-key table comes from the caller (``hot``: the keys and their count
    ``n``, as :func:`hot_keys` gives it) or from one grouped count over the key
    columns, a small job; when it is empty the plan is just the keyed window.
    ``detect_hot=False`` skips the count (only for inputs whose keys are known
    to be bounded).
    """
    keys, order, carry = list(keys), list(order), list(carry)
    df = df.na.drop(subset=keys)
    if hot is None and not detect_hot:
        return _plain(df, keys, order, carry, value)
    if hot is None:
        hot = hot_keys(df, keys, target_rows)
    hot = hot.select(*keys, F.col("n").alias("_kn"))
    found = hot.agg(F.sum("_kn")).first()[0]
    if not found:
        # no key above target_rows: one keyed window is bounded already
        return _plain(df, keys, order, carry, value)
    hot = F.broadcast(hot)
    cold = df.join(hot, keys, "left_anti")
    rows = df.join(hot, keys, "inner")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * found // target_rows)
    ranked = global_rank(rows, order, keys, "_rank", num_partitions=min(parts, 100_000))
    ranked = ranked.withColumn("_seg", F.floor(F.col("_rank") / target_rows).cast("long")) \
        .withColumn("pos", F.col("_rank") + 1).withColumn("n", F.col("_kn").cast("long")).drop("_rank", "_kn")
    a = _plain(cold, keys, order, carry, value)
    b = _segmented(ranked, keys, order, carry, value)
    return a.unionByName(b.select(*a.columns))
