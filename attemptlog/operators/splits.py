"""Person-level splits and indexes.

Ranking a whole population (a dense index, a stratified fold) normally means a
window with one big partition.  :func:`global_rank` computes exact 0-based
ranks without that: range-partition the rows, cut the lineage so the range
bounds (picked by sampling) are fixed, count per (group, partition), turn the
counts into offsets on that small table, and add a per-partition local rank.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlog.session import cut_lineage


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Exact 0-based rank of each row by ``order`` within ``by`` groups.

    ``order`` must be unique within a group.  No task ever holds more than one
    range partition; the offset table has one row per (group, partition).
    """
    by, order = list(by), list(order)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *[F.col(c) for c in by + order]) \
          .withColumn("_p", F.spark_partition_id())
    r = cut_lineage(r)
    counts = r.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    wo = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_p") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0))).drop("_n")
    local = r.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)))
    # the offset table is bounded by (#groups x #partitions); let AQE pick the join
    # (null-safe: NULL is a group like any other)
    offs = offs.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_p").alias("_op"), "_off")
    same = F.col("_p") == F.col("_op")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    j = local.join(offs, same, "inner")
    return j.withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("long")) \
        .drop("_p", "_op", "_r", "_off", *[f"_by{k}" for k in range(len(by))])


def index_students(df: DataFrame, col: str = "student_id", out: str = "student_id_encoded",
                   by: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based index of the sorted distinct ids (per ``by`` group,
    e.g. per dataset, Q14).  Returns the mapping table."""
    ids = df.select(*by, col).distinct()
    return global_rank(ids, [col], by, out)


def student_label(df: DataFrame, student: str = "student_id", label: str = "Label",
                  order: Sequence[str] = ("new_task_id",)) -> DataFrame:
    """One label per student -- the label of the first row by an explicit
    order (never an arbitrary ``first``)."""
    return df.groupBy(student).agg(
        F.min_by(F.col(label), F.struct(*[F.col(c) for c in order])).alias(label))


def seeded_order(student: str, seed: int):
    """A seeded pseudo-random order of ids: md5 of seed and id, as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(student).cast("string")))


def stratified_folds(labels: DataFrame, k: int = 5, seed: int = 42,
                     student: str = "student_id", label: str = "Label") -> DataFrame:
    """Students of each label ordered by a seeded hash and dealt round-robin
    into ``k`` folds, so per-label fold sizes differ by at most one.  Students with
    a NULL label form a stratum of their own."""
    r = global_rank(labels.withColumn("_h", seeded_order(student, seed)), ["_h", student], [label], "_rank")
    return r.select(student, label, (F.col("_rank") % k).cast("int").alias("fold"))


def stratified_split(labels: DataFrame, fractions=(0.7, 0.1, 0.2), seed: int = 42,
                     names=("train", "valid", "test"), student: str = "student_id",
                     label: str = "Label") -> DataFrame:
    """Per-label cut of the seeded hash order into train/valid/test."""
    r = global_rank(labels.withColumn("_h", seeded_order(student, seed)), ["_h", student], [label], "_rank")
    sizes = labels.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(sizes, F.col(label).eqNullSafe(F.col("_l")), "inner")
    frac = F.col("_rank") / F.col("_n")
    c1, c2 = fractions[0], fractions[0] + fractions[1]
    split = F.when(frac < c1, names[0]).when(frac < c2, names[1]).otherwise(names[2])
    return r.select(student, label, split.alias("split"))


def split_overlap(splits: DataFrame, student: str = "student_id", split: str = "split") -> DataFrame:
    """Students that appear in two different splits (expected empty)."""
    a = splits.select(student, F.col(split).alias("_a"))
    b = splits.select(student, F.col(split).alias("_b"))
    return a.join(b, student, "inner").filter(F.col("_a") < F.col("_b")) \
            .select(student, F.col("_a").alias("split_a"), F.col("_b").alias("split_b"))


def split_intersection(a: DataFrame, b: DataFrame, student: str = "student_id") -> DataFrame:
    """Ids present in both sets."""
    return a.select(student).intersect(b.select(student))


def filter_students(df: DataFrame, ids: DataFrame, student: str = "student_id") -> DataFrame:
    """Membership filter (left semi join)."""
    return df.join(ids.select(student), student, "left_semi")


def split_report(rows: DataFrame, splits: DataFrame, split: str = "split",
                 student: str = "student_id", label: str = "Label") -> DataFrame:
    """Rows, students and label share per split."""
    j = rows.join(splits.select(student, split), student, "inner")
    return j.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(student).alias("n_students"),
        F.avg(F.col(label).cast("double")).alias("label_share"))


def union_courses(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of same-shaped per-course tables."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two datasets with different columns (missing -> NULL)."""
    return a.unionByName(b, allowMissingColumns=True)


def merged_training(a: DataFrame, b: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training rows of both datasets together; test rows kept apart with a
    ``dataset`` column."""
    a = a.withColumn("dataset", F.lit(0))
    b = b.withColumn("dataset", F.lit(1))
    train = union_datasets(a.filter(F.col(fold_col) != fold), b.filter(F.col(fold_col) != fold))
    test = union_datasets(a.filter(F.col(fold_col) == fold), b.filter(F.col(fold_col) == fold))
    return train, test
