"""Descriptive profiling of attempt summaries.

Inputs are the per-task summary of :func:`attempts.summarize_attempts` or the
flat sequenced rows of :func:`attempts.attempt_rows`.  All aggregates are
map-side combinable (count, sum, min, max, avg, exact ``percentile`` which keeps
a count per distinct value), so a hot problem does not end up in one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.select import exact_percentiles


def dataset_profile(summary: DataFrame, student: str = "student_id",
                    problem: str = "problem_id", section: str | None = None) -> DataFrame:
    """Snapshot total, distinct students / problems / sections / pairs (one row)."""
    aggs = [F.sum("num_snapshots").cast("long").alias("n_snapshots"),
            F.count_distinct(student).alias("n_students"),
            F.count_distinct(problem).alias("n_problems"),
            F.count_distinct(student, problem).alias("n_pairs")]
    if section:
        aggs.append(F.count_distinct(section).alias("n_sections"))
    return summary.agg(*aggs)


def problems_per_student(summary: DataFrame, student: str = "student_id",
                         problem: str = "problem_id") -> DataFrame:
    """Distinct problems per student."""
    return summary.groupBy(student).agg(F.count_distinct(problem).alias("n_problems"))


def snapshot_stats(summary: DataFrame, problem: str = "problem_id",
                   student: str = "student_id", col: str = "num_snapshots") -> DataFrame:
    """Students, min, max, mean, median of snapshots per problem."""
    return summary.groupBy(problem).agg(
        F.count_distinct(student).alias("number_of_students"),
        F.min(col).alias("min_snapshots"),
        F.max(col).alias("max_snapshots"),
        F.avg(col).alias("mean_snapshots"),
        F.percentile(F.col(col), F.lit(0.5)).alias("median_snapshots"),
    )


def time_stats(summary: DataFrame, problem: str = "problem_id",
               student: str = "student_id") -> DataFrame:
    """A10: time-to-solve and per-task mean gap statistics per problem, minutes.

    Tasks with a single attempt are left out (they have no gap).  Times are nearly
    all distinct, so both medians come from counters over the bits of the values
    (:mod:`attemptlog.operators.select`), not from a map of values per problem.
    """
    s = summary.filter((F.col("num_snapshots") > 1) & F.col(problem).isNotNull()).select(
        problem, student, (F.col("time_to_solve") / 60.0).alias("_t"), (F.col("mean_gap") / 60.0).alias("_g"))
    t, g = F.col("_t"), F.col("_g")
    medians = exact_percentiles(s, [problem], {"_t": "median_time_to_solve", "_g": "median_time_between_snapshots"})
    stats = s.groupBy(problem).agg(
        F.count_distinct(student).alias("number_of_students"),
        F.min(t).alias("min_time_to_solve"),
        F.max(t).alias("max_time_to_solve"),
        F.avg(t).alias("mean_time_to_solve"),
        F.avg(g).alias("mean_time_between_snapshots"),
    )
    return stats.join(medians, problem, "left")


def success_rate(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Success / failure counts and the failure rate (percent)."""
    s = F.col("success").cast("boolean")
    g = summary.groupBy(*by) if by else summary.groupBy()
    return g.agg(F.count_if(s).alias("n_success"), F.count_if(~s).alias("n_fail"),
                 (F.count_if(~s) * 100.0 / F.count(F.lit(1))).alias("fail_rate"))


def snapshots_by_outcome(summary: DataFrame) -> DataFrame:
    """Total snapshots per outcome."""
    return summary.groupBy(F.col("success").cast("long").alias("success")) \
                  .agg(F.sum("num_snapshots").cast("long").alias("n_snapshots"))


def single_attempt_failures(summary: DataFrame, perfect: float = 100.0) -> DataFrame:
    """Failed tasks with a single attempt (one row)."""
    c = (F.col("num_snapshots") == 1) & (F.col("max_score") < perfect)
    return summary.agg(F.count_if(c).alias("n_single_attempt_failures"))


def value_distribution(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Value counts, absolute and normalised within ``by``.

    The totals come from a grouped aggregate joined back on ``by`` (a tiny
    table), never from an unpartitioned window.
    """
    by = list(by)
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("count"))
    if by:
        tot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
        counts = counts.join(tot, by, "inner")
    else:
        tot = df.agg(F.count(F.lit(1)).alias("_total"))
        counts = counts.crossJoin(tot)  # one-row total
    return counts.withColumn("share", F.col("count") / F.col("_total")).drop("_total")


def align_distributions(a: DataFrame, b: DataFrame, value: str, col: str = "share",
                        names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Outer-align two distributions on the value, missing = 0."""
    x = a.select(value, F.col(col).alias(names[0]))
    y = b.select(value, F.col(col).alias(names[1]))
    return x.join(y, value, "full").na.fill(0, subset=list(names))


def histogram(df: DataFrame, col: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram (numpy rule: last bin closed) with all bins.

    Per group min/max from one aggregate, bin by arithmetic, then a dense spine
    of ``bins`` rows so empty bins appear with 0.
    """
    by = list(by)
    rng = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    j = df.join(rng, by, "inner") if by else df.crossJoin(rng)
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.floor((F.col(col) - F.col("_lo")) / width))
    b = F.least(raw, F.lit(bins - 1)).cast("long")
    counts = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = rng.crossJoin(df.sparkSession.range(bins).withColumnRenamed("id", "bin"))
    out = spine.join(counts, by + ["bin"], "left").na.fill(0, subset=["count"])
    lo = F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins
    hi = F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*by, "bin", lo.alias("bin_lo"), hi.alias("bin_hi"), "count")


def position_curve(rows: DataFrame, value: str, problem: str = "problem_id",
                   pos: str = "pos") -> DataFrame:
    """Mean and count of ``value`` per (problem, position)."""
    return rows.groupBy(problem, F.col(pos).alias("snapshot")).agg(
        F.avg(value).alias("mean_value"), F.count(value).alias("n_students"))


def position_curve_overall(curve: DataFrame) -> DataFrame:
    """Mean of the per-problem means and sum of counts per position."""
    return curve.groupBy("snapshot").agg(F.avg("mean_value").alias("mean_value"),
                                         F.sum("n_students").cast("long").alias("n_students"))


def having_support(curve: DataFrame, min_students: int = 10, strict: bool = True,
                   max_snapshot: int | None = None, exact_positions: int | None = None,
                   problem: str = "problem_id") -> DataFrame:
    """Keep positions with enough students; optionally only problems with
    exactly ``exact_positions`` positions left (a per-problem count, bounded by
    the number of positions)."""
    c = F.col("n_students")
    out = curve.filter(c > min_students if strict else c >= min_students)
    if max_snapshot is not None:
        out = out.filter(F.col("snapshot") <= max_snapshot)
    if exact_positions is not None:
        k = out.groupBy(problem).agg(F.count(F.lit(1)).alias("_k")) \
               .filter(F.col("_k") == exact_positions).select(problem)
        out = out.join(k, problem, "left_semi")
    return out


def curve_min(curve: DataFrame, problem: str = "problem_id") -> DataFrame:
    """Minimum of the curve per problem."""
    return curve.groupBy(problem).agg(F.min("mean_value").alias("min_value"))


def line_change_distribution(changes: DataFrame, summary_snapshots: DataFrame,
                             by: Sequence[str] = ()) -> DataFrame:
    """Histogram of deleted/inserted counts divided by total snapshots."""
    by = list(by)
    long = changes.select(*by, F.explode(F.array(
        F.struct(F.lit("deleted").alias("kind"), F.col("deleted").alias("n_lines")),
        F.struct(F.lit("inserted").alias("kind"), F.col("inserted").alias("n_lines")))).alias("x")) \
        .select(*by, "x.kind", "x.n_lines")
    counts = long.groupBy(*by, "kind", "n_lines").agg(F.count(F.lit(1)).alias("count"))
    j = counts.join(summary_snapshots, by, "inner") if by else counts.crossJoin(summary_snapshots)
    return j.withColumn("share", F.col("count") / F.col("n_snapshots")).drop("n_snapshots")
