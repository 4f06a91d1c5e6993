"""Skill vectors and task similarity.

Vector math stays inside higher-order functions (``transform``, ``zip_with``,
``aggregate``) so it is code-generated on the JVM.  The column-wise min/max of
K5 is one global aggregate whose result has exactly ``size`` entries.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlog.session import cut_lineage


def last_or_zero(c) -> Column:
    """last element of an array, 0 when it is empty or NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """cosine similarity of two vectors (NULL when a norm is 0)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(None)).otherwise(dot(a, b) / (na * nb))


def unit_vector(v: Column) -> Column:
    """The vector divided by its length (NULL where that is 0)."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n))


def score_vector(prev_scores: str = "prev_scores", n: int = 30) -> Column:
    """Last score of each history task, padded with 0 to ``n``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(
        i < F.size(prev_scores), last_or_zero(F.col(prev_scores)[i])).otherwise(F.lit(0.0)))


def append_latents(cons: str = "prev_comp_cons", k: int = 3) -> Column:
    """append ``k`` ones to every concept vector."""
    return F.transform(cons, lambda v: F.concat(v, F.array_repeat(F.lit(1.0), k)))


def raw_skills(df: DataFrame, size: int = 10, n: int = 30, latents: bool = False,
               similarity: str | None = None, cons: str = "prev_comp_cons",
               prev_scores: str = "prev_scores", out: str = "skills_raw") -> DataFrame:
    """(tasks x concepts)^T . scores, optionally weighted by similarity."""
    df = df.withColumn("score_vec", score_vector(prev_scores, n))
    m = F.col(cons)
    if latents:
        m = append_latents(cons)
        size += 3
    s = F.col("score_vec")
    if similarity:
        s = F.zip_with(F.col(similarity), s, lambda a, b: F.coalesce(a, F.lit(0.0)) * b)

    def per_concept(t):
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.aggregate(
            F.zip_with(t["m"], t["s"], lambda v, x: F.coalesce(v[j], F.lit(0.0)) * x), F.lit(0.0),
            lambda acc, x: acc + F.coalesce(x, F.lit(0.0))))
    # a one-element array binds matrix and scores to a lambda, so they are made once and not for each concept
    return df.withColumn(out, F.transform(F.array(F.struct(m.alias("m"), s.alias("s"))), per_concept)[0])


def column_range(df: DataFrame, col: str, size: int) -> DataFrame:
    """Column-wise min and max of a vector column (a one-row table)."""
    ex = df.select(F.posexplode(col).alias("_j", "_x"))
    per = ex.groupBy("_j").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return per.agg(F.sort_array(F.collect_list(F.struct("_j", "_lo", "_hi"))).alias("_r")) \
              .select(F.transform("_r", lambda r: r["_lo"]).alias("_mins"),
                      F.transform("_r", lambda r: r["_hi"]).alias("_maxs"))


def minmax_fill(df: DataFrame, col: str, rng: DataFrame, out: str = "skills_vec") -> DataFrame:
    """F16 + F17 (Q13): scale to [0, 1] with the given ranges (zero range -> 1),
    then replace entries <= 0 by the mean of the scaled row."""
    j = df.crossJoin(F.broadcast(rng))  # one row, size entries
    scaled = F.transform(col, lambda x, i: (x - F.col("_mins")[i]) / F.when(
        (F.col("_maxs")[i] - F.col("_mins")[i]) == 0, F.lit(1.0))
        .otherwise(F.col("_maxs")[i] - F.col("_mins")[i]))
    j = j.withColumn("_scaled", scaled)
    mean = F.aggregate("_scaled", F.lit(0.0), lambda a, x: a + x) / F.size("_scaled")
    j = j.withColumn("_mean", mean)
    return j.withColumn(out, F.transform("_scaled", lambda x: F.when(x > 0, x).otherwise(F.col("_mean")))) \
            .drop("_mins", "_maxs", "_scaled", "_mean")


def skills_vector(df: DataFrame, size: int = 10, n: int = 30, latents: bool = False,
                  similarity: str | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """K5: skill vector per row.  The min-max range is fitted on all rows by
    default (Q12, as the reference does); pass ``fit_on`` (e.g. the training
    fold after the same :func:`raw_skills`) to avoid the leak."""
    # the raw vectors feed the column range and the rows: materialise once
    raw = cut_lineage(raw_skills(df, size, n, latents, similarity))
    width = size + (3 if latents else 0)
    rng = column_range(fit_on if fit_on is not None else raw, "skills_raw", width)
    return minmax_fill(raw, "skills_raw", rng)


def rubric_averages(scores: DataFrame, cols: Sequence[str] = ("decomposition", "alg", "reading"),
                    scale: float = 5.0, names: Sequence[str] = ("dec_avg", "alg_avg", "read_avg")) -> DataFrame:
    """Mean of the non-missing rubric scores divided by ``scale``."""
    out = scores
    for c, n in zip(cols, names):
        nn = F.filter(c, lambda x: x.isNotNull())
        out = out.withColumn(n, F.when(F.size(nn) == 0, F.lit(None)).otherwise(
            F.aggregate(nn, F.lit(0.0), lambda a, x: a + x / scale) / F.size(nn)))
    return out


def extend_with_rubric(df: DataFrame, scores: DataFrame, keys: Sequence[str] = ("student_id", "course_id"),
                       col: str = "skills_vec") -> DataFrame:
    """K6: append the three rubric averages to the skill vector (left join by
    ``keys``; the score table must hold one row for each)."""
    avg = rubric_averages(scores).select(*keys, "dec_avg", "alg_avg", "read_avg")
    j = df.join(avg, list(keys), "left")
    return j.withColumn(col, F.concat(F.col(col), F.array("dec_avg", "alg_avg", "read_avg")))


def task_pairs(targets: DataFrame, history: DataFrame, group: Sequence[str] = ("student_id", "course_id"),
               task: str = "problem_id", order: str = "row_number") -> DataFrame:
    """Every target task with every task of the person's history.

    ``targets`` and ``history`` have one row per task; a history holds at most
    ``n_hist`` tasks and a person at most ``n_last - n_hist`` targets, so the equi-join
    on the person is bounded per person."""
    group = list(group)
    h = history.select(*group, F.col(task).alias("prev_id"), F.col(order).alias("position"))
    return targets.select(*group, F.col(task).alias("target_id")).join(h, group, "inner")


def task_similarity(targets: DataFrame, history: DataFrame, vectors: DataFrame,
                    group: Sequence[str] = ("student_id", "course_id"), task: str = "problem_id",
                    order: str = "row_number") -> DataFrame:
    """K7: cosine similarity of each target to all previous tasks, from the question
    vectors (``id``, ``vec``; questions without one give NULL).

    Only ids are paired.  Each vector is brought to length one once, and each distinct
    pair of questions takes one product of two such vectors."""
    pairs = task_pairs(targets, history, group, task, order)
    unit = vectors.select(F.col("id").alias("_id"), unit_vector(F.col("vec")).alias("_u"))
    distinct = pairs.select("target_id", "prev_id").distinct()
    cos = distinct.join(unit.withColumnsRenamed({"_id": "target_id", "_u": "_a"}), "target_id") \
        .join(unit.withColumnsRenamed({"_id": "prev_id", "_u": "_b"}), "prev_id") \
        .select("target_id", "prev_id", dot(F.col("_a"), F.col("_b")).alias("similarity"))
    return pairs.join(cos, ["target_id", "prev_id"], "left")


def similarity_arrays(similar: DataFrame, group: Sequence[str] = ("student_id", "course_id"),
                      out: str = "similarities") -> DataFrame:
    """per target the similarities in the order of the history (one array of at
    most ``n_hist`` entries); 0 where a question has no vector."""
    g = similar.groupBy(*group, "target_id").agg(F.sort_array(F.collect_list(
        F.struct("position", F.coalesce("similarity", F.lit(0.0)).alias("s")))).alias("_s"))
    return g.select(*group, "target_id", F.transform("_s", lambda x: x["s"]).alias(out))
