"""Exact distinct counts that merge (A7, A9): bitmaps over the dense ids of W8.

A distinct count cannot be added up: a student of two sections is one student of
the course.  A bitmap of student ids can.  The table of :func:`id_bitmaps` is made
once; every coarser level, and every union with the bitmaps of further attempts,
comes from it by ``bitmap_or_agg`` without reading attempts again.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.splits import index_students
from attemptlog.session import cut_lineage

_SIZES = {"n_tasks": "sum", "n_snapshots": "sum", "min_snapshots": "min", "max_snapshots": "max"}


def id_bitmaps(rows: DataFrame, codes: DataFrame, by: Sequence[str], student: str = "student_id",
               code: str = "student_id_encoded") -> DataFrame:
    """One row a (``by``, bucket): the bitmap of the student ids in a range of 32,768
    dense ids, and the number, sum, least and greatest size of the tasks (rows of one
    student in a ``by`` group).

    ``codes`` maps every student to a dense id from 0 (:func:`splits.index_students`).
    Rows are counted per task before they meet their ids, so a hot student or group
    reaches the join as one row a task.  Rows without a student are a task of their group
    but set no bit; a null in ``by`` is a group; no rows give no bitmaps.  A bitmap has
    4 KB, mostly zeros where a group has few students, which the shuffle compresses.
    """
    by = list(by)
    tasks = rows.groupBy(*by, student).agg(F.count(F.lit(1)).alias("_size"))
    ids = codes.select(F.col(student).alias("_student"), F.col(code).alias("_id"))
    placed = tasks.join(ids, F.col(student) == F.col("_student"), "left")
    # the functions count ids from 1
    one = F.col("_id") + 1
    return placed.groupBy(*by, F.bitmap_bucket_number(one).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bitmap"),
        F.count(F.lit(1)).alias("n_tasks"), F.sum("_size").alias("n_snapshots"),
        F.min("_size").alias("min_snapshots"), F.max("_size").alias("max_snapshots"))


def merge_bitmaps(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """The bitmaps of the coarser groups ``by``; also of a union of several tables made
    with the same ids.  Sizes stay those of the tasks that were counted, so tables to
    be united must not hold parts of one task."""
    return bitmaps.groupBy(*by, "bucket").agg(
        F.bitmap_or_agg("bitmap").alias("bitmap"),
        *[getattr(F, f)(c).alias(c) for c, f in _SIZES.items()])


def count_bitmaps(bitmaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct students and task sizes of each group of merged bitmaps; one row
    without ``by``."""
    g = bitmaps.groupBy(*by) if by else bitmaps.groupBy()
    return g.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias("n_students"),
                 *[getattr(F, f)(c).alias(c) for c, f in _SIZES.items()])


def dataset_rollup(rows: DataFrame, section: str = "course_id", problem: str = "problem_id",
                   student: str = "student_id") -> DataFrame:
    """A7 and A9 at the levels ``problem`` (of a section), ``section`` and ``all``:
    snapshots, distinct students, problems, sections and (student, problem) pairs, and
    the least, greatest and mean number of snapshots of a task.

    One pass over the attempts; the levels come from the bitmaps.  Nulls are not counted
    as students, problems or sections, and give no pairs; a null section or problem
    has its own row.  Without rows the level ``all`` is left, with zeros.
    """
    codes = index_students(rows.filter(F.col(student).isNotNull()), student)
    base = cut_lineage(id_bitmaps(rows, codes, [section, problem], student))
    found = F.col(problem).isNotNull()
    leaf = count_bitmaps(base, [section, problem]).withColumn("n_pairs", F.when(found, F.col("n_students")).otherwise(0))
    one = leaf.withColumn("n_problems", found.cast("long")).withColumn("n_sections", F.col(section).isNotNull().cast("long"))
    per_section = leaf.groupBy(F.col(section).alias("_of")).agg(
        F.sum("n_pairs").alias("n_pairs"), F.count(problem).alias("n_problems"))
    mid = count_bitmaps(merge_bitmaps(base, [section]), [section]) \
        .join(per_section, F.col(section).eqNullSafe(F.col("_of"))).drop("_of") \
        .withColumn("n_sections", F.col(section).isNotNull().cast("long"))
    pairs = count_bitmaps(merge_bitmaps(base.filter(found), [problem]), [problem]).agg(
        F.coalesce(F.sum("n_students"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_problems"))
    sections = base.agg(F.count_distinct(section).alias("n_sections"))
    whole = count_bitmaps(merge_bitmaps(base, []), []).crossJoin(pairs).crossJoin(sections)   # tables of one row

    def level(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
        kept = [(F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in (section, problem)]
        n = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
             for c in ("n_snapshots", "n_students", "n_problems", "n_sections", "n_pairs")]
        return df.select(F.lit(name).alias("level"), *kept, *n, "min_snapshots", "max_snapshots",
                         (F.col("n_snapshots") / F.col("n_tasks")).alias("mean_snapshots"))
    return level(one, "problem", [section, problem]).unionByName(level(mid, "section", [section])) \
        .unionByName(level(whole, "all", []))
