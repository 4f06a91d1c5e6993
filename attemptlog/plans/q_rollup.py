"""Registered queries: mergeable distinct counts, samples of every group, lookups added to."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import bitmaps as B
from attemptlog.operators import examples as X
from attemptlog.operators import samples as SM
from attemptlog.plans.q_attempts import NO_BREAK, att_summary, deep_rows, deep_summary
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.session import scratch_path
from attemptlog.sources import lookup as L
from attemptlog.sources import views as V

_TASKS = [("t", """SELECT course_id, problem_id, student_id, count(*) AS k FROM attempts_big
  GROUP BY course_id, problem_id, student_id""")]
_SIZES = """CAST(sum(k) AS BIGINT) AS n_snapshots, CAST(count(DISTINCT student_id) AS BIGINT) AS n_students,
  CAST(count(DISTINCT problem_id) AS BIGINT) AS n_problems, CAST(count(DISTINCT course_id) AS BIGINT) AS n_sections,
  CAST(count(DISTINCT CASE WHEN problem_id IS NOT NULL AND student_id IS NOT NULL THEN (student_id, problem_id) END) AS BIGINT)
    AS n_pairs,
  CAST(min(k) AS BIGINT) AS min_snapshots, CAST(max(k) AS BIGINT) AS max_snapshots, round(avg(k), 6) AS mean_snapshots"""


@register("dataset_rollup", with_views(["attempts_big"], f"""
SELECT 'problem' AS level, course_id, problem_id, {_SIZES} FROM t GROUP BY course_id, problem_id
UNION ALL SELECT 'section', course_id, NULL, {_SIZES} FROM t GROUP BY course_id
UNION ALL SELECT 'all', NULL, NULL, {_SIZES} FROM t""", _TASKS))
def q_dataset_rollup(spark, d):
    return finalize(B.dataset_rollup(V.attempts_big(spark, d)))


@register("failure_samples", with_views(["att_summary"], f"""
SELECT student_id, problem_id, num_snapshots, max_gap, CAST(sample_no AS BIGINT) AS sample_no FROM c
WHERE sample_no <= 10 AND max_gap <= {NO_BREAK}""", [("c", """SELECT *, row_number() OVER (PARTITION BY problem_id
    ORDER BY md5(concat_ws(':', '42', student_id, problem_id)), student_id) AS sample_no
  FROM att_summary WHERE max_score IS DISTINCT FROM 100 AND num_snapshots BETWEEN 2 AND 12""")]))
def q_failure_samples(spark, d):
    s = SM.failure_samples(att_summary(spark, d), n=10, num_snapshots=(2, 12), max_gap=NO_BREAK)
    return finalize(s.select("student_id", "problem_id", "num_snapshots", "max_gap", "sample_no"))


_DRAWN = [("c", """SELECT *, row_number() OVER (PARTITION BY problem_id, success
    ORDER BY md5(concat_ws(':', '42', student_id, problem_id)), student_id) AS sample_no
  FROM deep_summary WHERE num_snapshots BETWEEN 8 AND 30""")]


@register("example_samples", with_views(["deep_summary"], """
SELECT student_id, problem_id, CAST(success AS BIGINT) AS success, num_snapshots, CAST(sample_no AS BIGINT) AS sample_no
FROM c WHERE sample_no <= 8""", _DRAWN))
def q_example_samples(spark, d):
    s = SM.example_samples(deep_summary(spark, d), n=8, lo=8, hi=30)
    return finalize(s.select("student_id", "problem_id", "success", "num_snapshots", "sample_no"))


@register("example_sample_series", with_views(["deep_summary", "deep_rows"], """
SELECT r.student_id, r.problem_id, CAST(r.pos - 1 AS BIGINT) AS step, round(r.gap / 60.0, 6) AS value
FROM deep_rows r JOIN c USING (student_id, problem_id) WHERE r.pos >= 2 AND c.sample_no <= 8""", _DRAWN))
def q_example_sample_series(spark, d):
    s = SM.example_samples(deep_summary(spark, d), n=8, lo=8, hi=30)
    return finalize(X.example_series(s, deep_rows(spark, d)))


@register("embed_upsert", r"""
SELECT md5(code) AS snippet_md5, CAST(min(CASE WHEN role = 'user' THEN 1 ELSE 2 END) AS BIGINT) AS load,
  CASE WHEN regexp_matches(code, '[\p{L}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM (SELECT text AS code, role FROM conversations) WHERE code IS NOT NULL GROUP BY code""")
def q_embed_upsert(spark, d):
    s, path = V.snapshots(spark, d), scratch_path(spark, "lookup")
    L.embed_new(spark, path, s.filter(F.col("role") == "user"), load=1)
    L.embed_new(spark, path, s, load=2)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return finalize(L.load_lookup(spark, path).select(F.md5("code").alias("snippet_md5"), "load", norm.alias("norm")))


@register("upsert_later_wins", """
SELECT md5(text) AS snippet_md5, CAST(arg_max(turn, (role = 'assistant', turn)) AS BIGINT) AS ord
FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant') GROUP BY text""")
def q_upsert_later_wins(spark, d):
    s, path = V.snapshots(spark, d), scratch_path(spark, "lookup")
    for role in ("user", "assistant"):
        L.upsert_lookup(spark, path, s.filter(F.col("role") == role).select("code", "ord"))
    return finalize(L.load_lookup(spark, path).select(F.md5("code").alias("snippet_md5"), "ord"))
