"""Registered queries: limits and examples, two-key lookups, unions and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import examples as X
from attemptlog.operators import history as H
from attemptlog.operators import joins as J
from attemptlog.operators import splits as SP
from attemptlog.operators.attempts import dataset_flag
from attemptlog.plans.q_attempts import NO_BREAK, _time_curve, deep_rows, deep_summary
from attemptlog.plans.q_history import B_KEYS, N_HIST, SUBS_SQL, b_stages
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.session import cut_lineage
from attemptlog.sources import views as V

TIME_CURVE = """, tc AS (SELECT problem_id, pos - 1 AS snapshot, avg(gap / 60.0) AS mean_value,
        count(gap) AS n_students FROM deep_rows WHERE n > 1 AND n >= 10 AND pos >= 2
        GROUP BY problem_id, pos - 1)"""


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


@register("head_curve", _fix(with_views(["deep_rows"], TIME_CURVE + """
SELECT problem_id, CAST(snapshot AS BIGINT) AS snapshot, round(mean_value, 6) AS mean_value,
  CAST(n_students AS BIGINT) AS n_students FROM tc ORDER BY problem_id, snapshot LIMIT 40""")))
def q_head_curve(spark, d):
    return finalize(X.head(_time_curve(spark, d), 40, ["problem_id", "snapshot"]))


@register("examples", with_views(["deep_summary"], """
SELECT student_id, problem_id, num_snapshots, CAST(success AS BIGINT) AS success FROM deep_summary
WHERE problem_id = 'click' AND NOT success AND num_snapshots BETWEEN 8 AND 10
ORDER BY student_id LIMIT 8"""))
def q_examples(spark, d):
    e = X.examples(deep_summary(spark, d), "click", 0, 8, 10, 8)
    return finalize(e.select("student_id", "problem_id", "num_snapshots", "success"))


@register("example_series", with_views(["deep_summary", "deep_rows"], """
, ch AS (SELECT student_id, problem_id FROM deep_summary
         WHERE problem_id = 'click' AND NOT success AND num_snapshots BETWEEN 8 AND 10
         ORDER BY student_id LIMIT 8)
SELECT r.student_id, r.problem_id, CAST(r.pos - 1 AS BIGINT) AS step, round(r.gap / 60.0, 6) AS value
FROM deep_rows r JOIN ch USING (student_id, problem_id) WHERE r.pos >= 2""").replace("\n)\n, ch AS", "\n),\nch AS"))
def q_example_series(spark, d):
    e = X.examples(deep_summary(spark, d), "click", 0, 8, 10, 8)
    return finalize(X.example_series(e, deep_rows(spark, d)))


@register("sample_failures", with_views(["deep_summary"], """
, c AS (SELECT * FROM deep_summary WHERE max_score IS DISTINCT FROM 100 AND num_snapshots BETWEEN 8 AND 12
        ORDER BY md5('42:' || student_id || ':' || problem_id), student_id, problem_id LIMIT 10)
SELECT student_id, problem_id, num_snapshots, max_gap FROM c WHERE max_gap <= {NO_BREAK}
""".format(NO_BREAK=NO_BREAK)).replace("\n)\n, c AS", "\n),\nc AS"))
def q_sample_failures(spark, d):
    s = X.sample_failures(deep_summary(spark, d), n=10, seed=42, num_snapshots=(8, 12),
                          max_gap=NO_BREAK)
    return finalize(s.select("student_id", "problem_id", "num_snapshots", "max_gap"))


QBC_SQL = """, qbc AS (SELECT l_partkey % 100 AS id, o_orderpriority AS course, max(l_quantity) AS max_score,
        o_orderpriority || ' / ' || CAST(min(l_partkey) AS VARCHAR) AS prompt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 3 <> 0 GROUP BY 1, 2),
t AS (SELECT student_id, course_id, problem_id, max(score) AS max_score FROM big_rows
      WHERE best_pos IS NULL OR pos <= best_pos GROUP BY 1, 2, 3)"""


@register("attach_questions", _fix(with_views(["big_rows"], QBC_SQL + """
SELECT t.student_id, t.course_id, t.problem_id, round(t.max_score, 6) AS max_score,
  round(q.max_score, 6) AS max_score_q, q.prompt
FROM t JOIN qbc q ON t.course_id = q.course AND t.problem_id = q.id""")))
def q_attach_questions(spark, d):
    # the two-key catalogue: questions differ from course to course
    li = V.table(spark, d, "lineitem").filter("l_partkey % 3 <> 0").select("l_orderkey", "l_partkey", "l_quantity")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    q = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(
        (F.col("l_partkey") % V.N_QUESTIONS).alias("id"), F.col("o_orderpriority").alias("course")).agg(
        F.max("l_quantity").cast("double").alias("max_score"),
        F.min("l_partkey").alias("_first")).withColumn("prompt", F.concat_ws(" / ", "course", F.col("_first").cast("string"))).drop("_first")
    tasks = H.task_table(cut_lineage(V.attempts_big(spark, d)), B_KEYS, V.BIG_ORDER, trim="all", code=None, lists=False)
    j = J.attach_questions(tasks, q, ["course_id", "problem_id"], ["course", "id"])
    return finalize(j.select("student_id", "course_id", "problem_id", "max_score", "max_score_q", "prompt"))


@register("filter_students", _fix(with_views(["big_rows"], """
, t AS (SELECT student_id, course_id, problem_id, count(*) FILTER (WHERE score = 0) AS n_bad
        FROM big_rows WHERE pos <= best_pos GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY student_id, course_id ORDER BY problem_id) AS k FROM t),
g AS (SELECT student_id, course_id, sum(n_bad) AS bad FROM k WHERE k <= 31 GROUP BY 1, 2),
v AS (SELECT DISTINCT student_id FROM g WHERE bad <= 3)
SELECT user_id AS student_id, CAST(count(*) AS BIGINT) AS n_events FROM events
WHERE user_id IN (SELECT student_id FROM v) GROUP BY user_id""")))
def q_filter_students(spark, d):
    tasks = H.task_table(cut_lineage(V.attempts_big(spark, d)), B_KEYS, V.BIG_ORDER, trim="all", code=None,
                         lists=False, sentinel=0.0)
    ok = H.valid_students(tasks, n=31, max_bad=3, sentinel=0.0)
    a = SP.filter_students(V.attempts(spark, d), ok)
    return finalize(a.groupBy("student_id").agg(F.count(F.lit(1)).alias("n_events")))


@register("dataset_flag", """
SELECT CAST(dataset AS BIGINT) AS dataset, CAST(count(*) AS BIGINT) AS n_students FROM (
  SELECT DISTINCT 0 AS dataset, CAST(user_id AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS c FROM events
  UNION ALL SELECT DISTINCT 1, CAST(o_custkey AS VARCHAR), o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY dataset""")
def q_dataset_flag(spark, d):
    a = V.attempts(spark, d).select(F.col("student_id").cast("string")).distinct()
    b = V.attempts_big(spark, d).select(F.col("student_id").cast("string"), "course_id").distinct()
    u = dataset_flag(SP.union_datasets(a, b))
    return finalize(u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_students")))


@register("truncate_history", _fix(with_views(["attempts", "questions"], SUBS_SQL + f"""
SELECT n.student_id, n.course_id, n.problem_id AS new_task_id,
  (SELECT string_agg(CAST(m.problem_id AS VARCHAR), ',' ORDER BY m.row_number) FROM num m
   WHERE m.student_id = n.student_id AND m.course_id = n.course_id AND m.row_number <= 5) AS prev_tasks_id,
  h.prev_tasks_id AS prev_tasks_id_30
FROM num n JOIN hist h USING (student_id, course_id)
WHERE n.row_number > {N_HIST} AND n.row_number <= 50 AND h.num_tasks = {N_HIST}""")))
def q_truncate_history(spark, d):
    final = b_stages(spark, d)["final"].withColumn("_all", F.col("prev_tasks_id"))
    out = H.truncate_history(H.truncate_history(final, n=30, cols=("_all",)), n=5)
    return finalize(out.select("student_id", "course_id", "new_task_id",
                               F.array_join("prev_tasks_id", ",").alias("prev_tasks_id"),
                               F.array_join("_all", ",").alias("prev_tasks_id_30")))


@register("attach_embeddings", """
SELECT conv_id AS group_id, CAST(count(*) AS BIGINT) AS n_vectors,
  CAST(32 * count(text) AS BIGINT) AS n_values FROM conversations GROUP BY conv_id""")
def q_attach_embeddings(spark, d):
    from attemptlog.operators.jobs import embed_texts, load_embeddings
    s = V.snapshots(spark, d)
    hist = s.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("ord", "code"))).alias("_a")) \
            .select("group_id", F.array(F.transform("_a", lambda x: x["code"])).alias("prev_tasks"))
    snippets = s.select("code").filter(F.col("code").isNotNull()).distinct()
    emb = load_embeddings([embed_texts(snippets, dim=16), embed_texts(snippets, dim=32)])
    out = J.attach_embeddings(hist, emb, ["group_id"])
    v = F.flatten("prev_vecs")
    return finalize(out.select("group_id", F.size(v).cast("long").alias("n_vectors"),
                               F.aggregate(v, F.lit(0).cast("long"),
                                           lambda a, x: a + F.size(x).cast("long")).alias("n_values")))

