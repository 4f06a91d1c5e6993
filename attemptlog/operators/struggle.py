"""Struggle definitions.

All work on a per-task summary with ``time_to_solve``, ``num_snapshots``,
``max_gap`` and ``success``.  Per-problem baselines are grouped aggregates
(map-side combined); they are joined back on the problem key and the join
strategy is left to AQE, which broadcasts the baseline only when its measured
size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.select import least_means


def without_break_tasks(summary: DataFrame, max_gap: int = 900, inclusive: bool = False) -> DataFrame:
    """Tasks with more than one attempt and no break (Q17: ``< 900`` here)."""
    s = summary.filter(F.col("num_snapshots") > 1)
    g = F.col("max_gap")
    return s.filter(g <= max_gap if inclusive else g < max_gap)


def problem_baseline(tasks: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Mean, sample variance and sample std of time and attempts (Q21)."""
    return tasks.groupBy(problem).agg(
        F.avg("time_to_solve").alias("avg_time_to_solve"),
        F.var_samp("time_to_solve").alias("variance_time_to_solve"),
        F.stddev_samp("time_to_solve").alias("std_dev_time_to_solve"),
        F.avg("num_snapshots").alias("avg_attempts"),
        F.var_samp("num_snapshots").alias("variance_num_snapshots"),
        F.stddev_samp("num_snapshots").alias("std_dev_num_snapshots"),
    )


def fastest_count(summary_multi: DataFrame, student: str = "student_id",
                  problem: str = "problem_id") -> DataFrame:
    """N = floor(mean over problems of distinct students / 5) as a one-row table."""
    per = summary_multi.groupBy(problem).agg(F.count_distinct(student).alias("_s"))
    return per.agg(F.floor(F.avg("_s") / 5).cast("long").alias("top_n"))


def fastest_mean(tasks: DataFrame, top_n: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Mean of the N smallest times and attempt counts per problem."""
    return least_means(tasks.filter(F.col(problem).isNotNull()), [problem], {"time_to_solve": "top_20_time", "num_snapshots": "top_20_attempts"}, top_n)


def baseline_overview(baseline: DataFrame) -> DataFrame:
    """Mean over problems of the per-problem statistics (one row)."""
    return baseline.agg(F.avg("avg_time_to_solve").alias("avg_time_to_solve"),
                        F.avg("std_dev_time_to_solve").alias("std_dev_time_to_solve"))


def time_outliers(tasks: DataFrame, baseline: DataFrame, k: float = 2.0,
                  problem: str = "problem_id") -> DataFrame:
    """K9: tasks with time > mean + k * std of their problem (NULL std -> false, Q21)."""
    j = tasks.join(baseline.select(problem, "avg_time_to_solve", "std_dev_time_to_solve"),
                   problem, "inner")
    return j.filter(F.col("time_to_solve") >
                    F.col("avg_time_to_solve") + k * F.col("std_dev_time_to_solve"))


def score_failures(summary: DataFrame, perfect: float = 100.0) -> DataFrame:
    """Tasks whose best score is not the perfect one, whatever the last
    attempt is (a task without any score counts as failed)."""
    return summary.filter(F.coalesce(F.col("max_score") < F.lit(perfect), F.lit(True)))


def attempt_outliers(tasks: DataFrame, baseline: DataFrame, k: float = 2.0,
                     literal: bool = False, problem: str = "problem_id") -> DataFrame:
    """Attempts > mean + k * std; ``literal`` uses the variance as the
    centre, as the reference's code does (Q20)."""
    centre = "variance_num_snapshots" if literal else "avg_attempts"
    j = tasks.join(baseline.select(problem, centre, "std_dev_num_snapshots"), problem, "inner")
    return j.filter(F.col("num_snapshots") > F.col(centre) + k * F.col("std_dev_num_snapshots"))


def rule_struggle(tasks: DataFrame, fastest: DataFrame, problem: str = "problem_id",
                  long_s: int = 900, short_s: int = 300, min_attempts: int = 3) -> DataFrame:
    """> 15 min, or (> 5 min and > 2x fast time and > 3 attempts and > 2x fast attempts)."""
    j = tasks.join(fastest, problem, "inner")
    t, n = F.col("time_to_solve"), F.col("num_snapshots")
    cond = (t > long_s) | ((t > short_s) & (t > 2 * F.col("top_20_time")) &
                           (n > min_attempts) & (n > 2 * F.col("top_20_attempts")))
    return j.filter(F.coalesce(cond, F.lit(False)))


def merge_definitions(a: DataFrame, b: DataFrame, keys=("student_id", "problem_id")) -> DataFrame:
    """Full outer join of two struggle sets with an origin marker."""
    keys = list(keys)
    x = a.select(*keys).distinct().withColumn("_l", F.lit(True))
    y = b.select(*keys).distinct().withColumn("_r", F.lit(True))
    j = x.join(y, keys, "full")
    return j.select(*keys, F.when(F.col("_l") & F.col("_r"), "both")
                    .when(F.col("_l"), "left_only").otherwise("right_only").alias("merge"))


def struggle_rate(merged: DataFrame, total: DataFrame) -> DataFrame:
    """Share of tasks in the merged struggle set (total is a one-row count)."""
    n = merged.agg(F.count(F.lit(1)).alias("n_struggling"))
    return n.crossJoin(total).withColumn("struggle_rate",
                                         F.col("n_struggling") / F.col("n_tasks"))
