"""Limits, samples and example series.

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: every task keeps
its own top ``n`` and only those reach the final merge, so a limit never
gathers a whole table in one place.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.struggle import score_failures


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """L2: first ``n`` rows by an explicit order (the order must be total)."""
    return df.orderBy(*order).limit(n)


def sample_failures(summary: DataFrame, n: int = 10, seed: int = 42, num_snapshots: int | tuple[int, int] = 10,
                    max_gap: int | None = 600, keys: Sequence[str] = ("student_id", "problem_id")) -> DataFrame:
    """L4: a seeded sample of ``n`` failed tasks (best score not perfect) with
    ``num_snapshots`` attempts (a number, or least and most); sampled tasks with a long gap are then skipped (so at most ``n``
    rows come back, as in the original)."""
    lo, hi = num_snapshots if isinstance(num_snapshots, tuple) else (num_snapshots, num_snapshots)
    cand = score_failures(summary).filter(F.col("num_snapshots").between(lo, hi))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    s = cand.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")
    return s.filter(F.col("max_gap") <= max_gap) if max_gap is not None else s


def examples(summary: DataFrame, problem, outcome: int, lo: int = 8, hi: int = 10, n: int = 8,
             order: Sequence[str] = ("student_id",)) -> DataFrame:
    """Tasks of one problem and outcome with ``lo..hi`` attempts, first ``n``
    by an explicit order."""
    f = summary.filter((F.col("problem_id") == F.lit(problem)) &
                       (F.col("success").cast("int") == outcome) &
                       F.col("num_snapshots").between(lo, hi))
    return head(f, n, list(order))


def example_series(chosen: DataFrame, rows: DataFrame, keys: Sequence[str] = ("student_id", "problem_id"),
                   value: str = "gap", scale: float = 60.0) -> DataFrame:
    """For chosen tasks, the per-step series (step = position - 1, value
    per step, e.g. gap minutes or changed lines) from sequenced rows."""
    keys = list(keys)
    r = rows.join(chosen.select(*keys), keys, "left_semi").filter(F.col("pos") >= 2)
    return r.select(*keys, (F.col("pos") - 1).alias("step"), (F.col(value) / scale).alias("value"))
