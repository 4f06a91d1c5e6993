"""Exact prefix sums over an order, without a task that holds a whole group.

Rows are range-partitioned by (group, order) and written once, which fixes the
sampled range bounds.  A local window gives sums inside a range; a table with
one row per (group, range) gives what lies before it and the first row of the
next range.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlog.session import cut_lineage


def prefix_sums(df: DataFrame, order: Sequence[str], by: Sequence[str], sums: Mapping[str, str],
                rank: str | None = None, following: Mapping[str, str] | None = None) -> DataFrame:
    """Add exclusive prefix sums by ``order`` within ``by``.

    ``sums`` maps columns to the names of their sums over all earlier rows;
    ``rank`` names a 0-based rank; ``following`` maps columns to the names of their
    values in the next row (NULL in the last).  ``order`` must be unique in a
    group; NULL is a group like any other."""
    by, order, following = list(by), list(order), dict(following or {})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = cut_lineage(df.repartitionByRange(n, *[F.col(c) for c in by + order]).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy(*by, "_p").orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    x = r.withColumn("_r", F.row_number().over(local))
    for c, out in sums.items():
        x = x.withColumn(out, F.coalesce(F.sum(c).over(before), F.lit(0)))
    for c, out in following.items():
        x = x.withColumn(out, F.lead(c).over(local))
    key = F.struct(*[F.col(c) for c in order])
    seg = r.groupBy(*by, "_p").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{out}") for c, out in sums.items()],
        *[F.min_by(c, key).alias(f"_f_{out}") for c, out in following.items()])
    ranges = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_p")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_o_rank", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    for out in sums.values():
        seg = seg.withColumn(f"_o_{out}", F.coalesce(F.sum(f"_s_{out}").over(earlier), F.lit(0)))
    for out in following.values():
        seg = seg.withColumn(f"_x_{out}", F.lead(f"_f_{out}").over(ranges))
    seg = seg.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_p").alias("_op"),
                     F.col("_n").alias("_on"), "_o_rank", *[f"_o_{o}" for o in sums.values()],
                     *[f"_x_{o}" for o in following.values()])
    same = F.col("_p") == F.col("_op")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    j = x.join(seg, same, "inner")
    for out in sums.values():
        j = j.withColumn(out, F.col(out) + F.col(f"_o_{out}"))
    for out in following.values():
        j = j.withColumn(out, F.when(F.col("_r") == F.col("_on"), F.col(f"_x_{out}")).otherwise(F.col(out)))
    if rank:
        j = j.withColumn(rank, (F.col("_o_rank") + F.col("_r") - 1).cast("long"))
    return j.drop("_p", "_r", "_op", "_on", "_o_rank", *[f"_by{k}" for k in range(len(by))],
                  *[f"_o_{o}" for o in sums.values()], *[f"_x_{o}" for o in following.values()])

