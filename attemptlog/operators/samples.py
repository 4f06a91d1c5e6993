"""Seeded samples of every group at once."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlog.operators.struggle import score_failures


def seeded_hash(keys: Sequence[str], seed: int):
    """The place of a row in the seeded order: md5 of the seed and the keys, nulls left out."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_groups(rows: DataFrame, by: Sequence[str], n: int, keys: Sequence[str], seed: int = 42,
                  salts: int = 64, out: str = "sample_no") -> DataFrame:
    """The ``n`` rows of each ``by`` group with the least seeded hash of ``keys``, numbered
    from 1 in ``out``; smaller groups stay whole, and the sample of a bigger ``n`` starts with that of
    a smaller one.

    Two levels: every map task keeps its ``n`` least of each (group, salt) before the
    first shuffle, each (group, salt) the ``n`` least of those, each group the ``n`` least of at
    most ``n * salts`` rows.  So a hot group is spread over ``salts`` tasks and never
    whole in one.  ``keys`` name a row within its group; rows that share them are ordered by the other
    columns that can be ordered.  A null in ``by`` is a group.
    """
    by, keys = list(by), list(keys)
    rest = [f.name for f in rows.schema.fields
            if f.name not in keys + by and f.dataType.typeName() not in ("map", "variant")]
    order = ["_sample_hash", *keys, *rest]
    salted = rows.withColumn("_sample_hash", seeded_hash(keys, seed)) \
        .withColumn("_sample_salt", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(salts)))
    near = salted.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_sample_salt").orderBy(*order))) \
        .filter(F.col(out) <= n)
    return near.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))) \
        .filter(F.col(out) <= n).drop("_sample_hash", "_sample_salt")


def failure_samples(summary: DataFrame, n: int = 10, seed: int = 42, num_snapshots: tuple[int, int] = (10, 10),
                    max_gap: int | None = 600, problem: str = "problem_id", student: str = "student_id") -> DataFrame:
    """L4 for every problem: ``n`` failed tasks with ``num_snapshots`` (least, most) attempts;
    drawn tasks with a gap above ``max_gap`` are then skipped, so a problem may get fewer."""
    lo, hi = num_snapshots
    drawn = sample_groups(score_failures(summary).filter(F.col("num_snapshots").between(lo, hi)),
                          [problem], n, [student, problem], seed)
    return drawn if max_gap is None else drawn.filter(F.col("max_gap") <= max_gap)


def example_samples(summary: DataFrame, n: int = 8, lo: int = 8, hi: int = 10, seed: int = 42,
                    problem: str = "problem_id", student: str = "student_id") -> DataFrame:
    """L6 for every (problem, outcome): ``n`` tasks with ``lo`` to ``hi`` attempts.  Their series
    come from :func:`examples.example_series`."""
    return sample_groups(summary.filter(F.col("num_snapshots").between(lo, hi)), [problem, "success"], n,
                         [student, problem], seed)
