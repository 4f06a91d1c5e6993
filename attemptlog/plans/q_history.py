"""Registered queries: histories and the two preparation plans (K1, K2, ...)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attemptlog.operators import history as H
from attemptlog.operators.attempts import invert_labels
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.session import cut_lineage
from attemptlog.sources import views as V

N_HIST, N_LAST = 30, 50   # history length and last target task
B_KEYS = ["student_id", "course_id", "problem_id"]
B_ORDER = ["ts", "ord"]


def subs(spark, d):
    """Dataset-B-shaped submissions over events: course = 'course' + user % 3."""
    a = V.attempts(spark, d)
    return a.withColumn("course_id", F.concat(F.lit("course"), (F.col("student_id") % 3).cast("string")))


def _txt_nested(c):
    return F.array_join(F.transform(c, lambda s: F.coalesce(
        F.array_join(F.transform(s, lambda x: x.cast("string")), ","), F.lit(""))), ";")


def _txt(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")


def _n_nested(c):
    return F.aggregate(c, F.lit(0).cast("long"),
                       lambda acc, x: acc + F.coalesce(F.size(x), F.lit(0)).cast("long"))


# ----------------------------- SQL building blocks -----------------------------

SUBS_SQL = """, subs AS (SELECT student_id, 'course' || CAST(student_id % 3 AS VARCHAR) AS course_id,
        problem_id, ts, ord, score, code_id FROM attempts),
s0 AS (SELECT *, row_number() OVER w AS pos, lag(ts) OVER w AS prev_ts,
        max(score) OVER (PARTITION BY student_id, course_id, problem_id) AS best
        FROM subs WINDOW w AS (PARTITION BY student_id, course_id, problem_id ORDER BY ts, ord)),
s1 AS (SELECT *, min(CASE WHEN score = best THEN pos END)
        OVER (PARTITION BY student_id, course_id, problem_id) AS best_pos FROM s0),
tasks AS (SELECT student_id, course_id, problem_id,
        coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY pos), '') AS scores_txt,
        arg_min(ts, pos) AS start_time, arg_max(ts, pos) AS end_time,
        max(score) AS max_score, count(*) AS num_snapshots,
        count(*) FILTER (WHERE score = -1) AS n_bad
        FROM s1 WHERE best_pos IS NULL OR pos <= best_pos GROUP BY student_id, course_id, problem_id),
vk AS (SELECT *, row_number() OVER (PARTITION BY student_id, course_id ORDER BY problem_id) AS k
        FROM tasks),
valid AS (SELECT DISTINCT student_id FROM
        (SELECT student_id, course_id, sum(n_bad) AS bad FROM vk WHERE k <= 31 GROUP BY 1, 2)
        WHERE bad <= 30),
tq AS (SELECT t.*, q.type, trim(q.prompt) AS prompt FROM tasks t JOIN questions q ON t.problem_id = q.id
        WHERE t.student_id IN (SELECT student_id FROM valid) AND t.n_bad = 0),
p75 AS (SELECT problem_id, quantile_cont(num_snapshots, 0.75) AS p75 FROM tq GROUP BY problem_id),
lab AS (SELECT tq.*, p75.p75, (tq.num_snapshots <= p75.p75 AND coalesce(tq.max_score >= 100, false)) AS Label
        FROM tq JOIN p75 USING (problem_id) WHERE tq.type <> 'project'),
num AS (SELECT *, row_number() OVER (PARTITION BY student_id, course_id ORDER BY end_time, problem_id)
        AS row_number FROM lab),
hist AS (SELECT student_id, course_id, count(*) AS num_tasks,
        string_agg(CAST(problem_id AS VARCHAR), ',' ORDER BY row_number) AS prev_tasks_id,
        string_agg(scores_txt, ';' ORDER BY row_number) AS prev_scores,
        string_agg(CAST(NOT Label AS VARCHAR), ',' ORDER BY row_number) AS prev_labels,
        sum(num_snapshots) AS n_prev_codes
        FROM num WHERE row_number <= {n_hist} GROUP BY student_id, course_id)""".format(n_hist=N_HIST)


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


def b_stages(spark, d):
    """K2 stages on the driver tables (task table and numbered table are checkpointed)."""
    return H.submission_stages(subs(spark, d), V.questions(spark, d), n_hist=N_HIST,
                               n_last=N_LAST, order=B_ORDER)


def _b_numbered(spark, d):
    return b_stages(spark, d)["numbered"]


@register("prepare_submissions", _fix(with_views(["attempts", "questions"], SUBS_SQL + f"""
SELECT n.student_id, n.course_id, n.problem_id AS new_task_id, round(n.max_score, 6) AS max_score,
  n.prompt AS new_task, h.prev_tasks_id, h.prev_scores, h.prev_labels,
  CAST(h.n_prev_codes AS BIGINT) AS n_prev_codes, CAST(NOT n.Label AS BIGINT) AS Label,
  CAST(n.row_number AS BIGINT) AS task_number
FROM num n LEFT JOIN hist h USING (student_id, course_id)
WHERE n.row_number > {N_HIST} AND n.row_number <= {N_LAST} AND h.num_tasks = {N_HIST}""")))
def q_prepare_submissions(spark, d):
    out = b_stages(spark, d)["final"]
    return finalize(out.select(
        "student_id", "course_id", "new_task_id", "max_score", "new_task",
        F.array_join("prev_tasks_id", ",").alias("prev_tasks_id"),
        _txt_nested("prev_scores").alias("prev_scores"),
        _txt("prev_labels").alias("prev_labels"),
        _n_nested("prev_tasks").alias("n_prev_codes"),
        "Label", "task_number"))


@register("label_struggle", _fix(with_views(["big_rows"], """
, t AS (SELECT student_id, course_id, problem_id, count(*) AS num_snapshots, max(score) AS max_score
        FROM big_rows WHERE pos <= best_pos GROUP BY 1, 2, 3),
p AS (SELECT problem_id, quantile_cont(num_snapshots, 0.75) AS p75 FROM t GROUP BY problem_id)
SELECT t.student_id, t.course_id, t.problem_id, CAST(t.num_snapshots AS BIGINT) AS num_snapshots,
  round(p.p75, 6) AS p75, CAST(t.num_snapshots <= p.p75 AND t.max_score >= 100 AS BIGINT) AS Label
FROM t JOIN p USING (problem_id)""")))
def q_label_struggle(spark, d):
    tasks = H.task_table(cut_lineage(V.attempts_big(spark, d)), B_KEYS, V.BIG_ORDER, trim="all", code=None, lists=False)
    out = H.label_struggle(tasks)
    return finalize(out.select("student_id", "course_id", "problem_id", "num_snapshots",
                               "p75", "Label"))


@register("problem_percentile", _fix(with_views(["big_rows"], """
, t AS (SELECT student_id, course_id, problem_id, count(*) AS num_snapshots
        FROM big_rows WHERE pos <= best_pos GROUP BY 1, 2, 3)
SELECT problem_id, round(quantile_cont(num_snapshots, 0.75), 6) AS p75,
  round(quantile_cont(num_snapshots, 0.5), 6) AS p50 FROM t GROUP BY problem_id""")))
def q_problem_percentile(spark, d):
    tasks = H.task_table(cut_lineage(V.attempts_big(spark, d)), B_KEYS, V.BIG_ORDER, trim="all", code=None, lists=False)
    p75 = H.problem_percentile(tasks, 0.75)
    p50 = H.problem_percentile(tasks, 0.5, out="p50")
    return finalize(p75.join(p50, "problem_id"))


@register("valid_students", _fix(with_views(["big_rows"], """
, t AS (SELECT student_id, course_id, problem_id, count(*) FILTER (WHERE score = 0) AS n_bad
        FROM big_rows WHERE pos <= best_pos GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY student_id, course_id ORDER BY problem_id) AS k FROM t),
g AS (SELECT student_id, course_id, sum(n_bad) AS bad FROM k WHERE k <= 31 GROUP BY 1, 2)
SELECT DISTINCT student_id FROM g WHERE bad <= 3""")))
def q_valid_students(spark, d):
    tasks = H.task_table(cut_lineage(V.attempts_big(spark, d)), B_KEYS, V.BIG_ORDER, trim="all", code=None,
                         lists=False, sentinel=0.0)
    return finalize(H.valid_students(tasks, n=31, max_bad=3, sentinel=0.0))


@register("number_tasks", _fix(with_views(["attempts", "questions"], SUBS_SQL + f"""
SELECT student_id, course_id, problem_id, CAST(row_number AS BIGINT) AS row_number,
  CAST(row_number <= {N_HIST} AS BIGINT) AS is_early,
  CAST(row_number > {N_HIST} AND row_number <= {N_LAST} AS BIGINT) AS is_late
FROM num""")))
def q_number_tasks(spark, d):
    n = _b_numbered(spark, d)
    return finalize(n.select("student_id", "course_id", "problem_id", "row_number",
                             (F.col("row_number") <= N_HIST).alias("is_early"),
                             ((F.col("row_number") > N_HIST) & (F.col("row_number") <= N_LAST))
                             .alias("is_late")))


@register("early_late", _fix(with_views(["attempts", "questions"], SUBS_SQL + f"""
SELECT student_id, course_id, CAST(count(*) FILTER (WHERE row_number <= {N_HIST}) AS BIGINT) AS n_early,
  CAST(count(*) FILTER (WHERE row_number > {N_HIST} AND row_number <= {N_LAST}) AS BIGINT) AS n_late
FROM num GROUP BY student_id, course_id""")))
def q_early_late(spark, d):
    n = _b_numbered(spark, d)
    early, late = H.early_late(n, N_HIST, N_LAST)
    a = early.groupBy("student_id", "course_id").agg(F.count(F.lit(1)).alias("n_early"))
    b = late.groupBy("student_id", "course_id").agg(F.count(F.lit(1)).alias("n_late"))
    allg = n.select("student_id", "course_id").distinct()
    out = allg.join(a, ["student_id", "course_id"], "left").join(b, ["student_id", "course_id"], "left")
    return finalize(out.na.fill(0, subset=["n_early", "n_late"]))


@register("build_history", _fix(with_views(["attempts", "questions"], SUBS_SQL + """
SELECT student_id, course_id, CAST(num_tasks AS BIGINT) AS num_tasks, prev_tasks_id, prev_scores,
  prev_labels, CAST(n_prev_codes AS BIGINT) AS n_prev_codes FROM hist""")))
def q_build_history(spark, d):
    n = _b_numbered(spark, d)
    early, _ = H.early_late(n, N_HIST, N_LAST)
    h = invert_labels(H.build_history(early), scalars=(), arrays=("prev_labels",))
    return finalize(h.select(
        "student_id", "course_id", "num_tasks",
        F.array_join("prev_tasks_id", ",").alias("prev_tasks_id"),
        _txt_nested("prev_scores").alias("prev_scores"),
        _txt("prev_labels").alias("prev_labels"),
        _n_nested("prev_tasks").alias("n_prev_codes")))


@register("last_snapshots", _fix(with_views(["attempts", "questions"], SUBS_SQL + """
, r AS (SELECT s1.student_id, s1.course_id, s1.problem_id, s1.pos, n.row_number,
        count(*) OVER (PARTITION BY s1.student_id, s1.course_id, s1.problem_id) AS m
        FROM s1 JOIN num n USING (student_id, course_id, problem_id)
        WHERE (s1.best_pos IS NULL OR s1.pos <= s1.best_pos) AND n.row_number <= 30)
SELECT student_id, course_id, CAST(count(*) FILTER (WHERE pos > m - 2) AS BIGINT) AS n_kept,
  CAST(sum(pos) FILTER (WHERE pos > m - 2) AS BIGINT) AS pos_sum,
  CAST(count(*) FILTER (WHERE pos > m - 100) AS BIGINT) AS n_kept_100 FROM r GROUP BY student_id, course_id""")
                                      .replace(")\n, r AS", "),\nr AS")))
def q_last_snapshots(spark, d):
    # W12 with n = 2 (and the default of 100) on the history of every student (positions kept are checked)
    n = _b_numbered(spark, d)
    early, _ = H.early_late(n, N_HIST, N_LAST)
    early = early.withColumn("codes", F.transform(
        F.sequence(F.lit(1), F.size("scores")), lambda i: i.cast("string")))
    full = H.build_history(early)
    h = H.last_snapshots(full.withColumn("hundred", F.col("prev_tasks")), n=2)
    h = H.last_snapshots(h, n=100, col="hundred")
    kept = F.flatten("prev_tasks")
    return finalize(h.select(
        "student_id", "course_id", F.size(kept).cast("long").alias("n_kept"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda a, p: a + p.cast("long")).alias("pos_sum"),
        F.size(F.flatten("hundred")).cast("long").alias("n_kept_100")))


# ------------------------------- dataset A (K1) -------------------------------

A_SQL = """, ev AS (SELECT a.*, CASE WHEN a.student_id % 2 = 1 THEN '0' ELSE 'UTC' END AS zone FROM attempts a),
code AS (SELECT event_id AS code_id, props AS code FROM events WHERE event_type <> 'signup'),
lt AS (SELECT student_id, problem_id, min(ord) AS o, coalesce(max(score) = 100, false) AS Label
       FROM attempts GROUP BY student_id, problem_id),
ltn AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY o, problem_id) AS k FROM lt),
early AS (SELECT student_id, problem_id, Label FROM ltn WHERE k <= 30),
late AS (SELECT student_id, problem_id, Label FROM ltn WHERE k > 30 AND k <= 50),
ev2 AS (SELECT ev.student_id, ev.problem_id, ev.ord, ev.score, c.code,
        CASE WHEN ev.zone = '0' THEN timezone('UTC', timezone('US/Eastern', ev.ts)) ELSE ev.ts END AS ts
        FROM ev JOIN code c ON ev.code_id = c.code_id),
a0 AS (SELECT *, row_number() OVER w AS pos, max(score) OVER (PARTITION BY student_id, problem_id) AS best
       FROM ev2 WINDOW w AS (PARTITION BY student_id, problem_id ORDER BY ord)),
a1 AS (SELECT *, min(CASE WHEN score = best THEN pos END) OVER (PARTITION BY student_id, problem_id) AS best_pos FROM a0),
tasks AS (SELECT a1.student_id, a1.problem_id, max(score) AS max_score, arg_max(ts, pos) AS end_time,
        coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY pos), '') AS scores_txt,
        count(*) FILTER (WHERE best IS NULL OR best <> 100 OR pos <= best_pos) AS n_codes,
        count(*) AS n_times, trim(q.prompt) AS prompt
        FROM a1 JOIN questions q ON a1.problem_id = q.id GROUP BY a1.student_id, a1.problem_id, q.prompt),
et AS (SELECT e.student_id, e.problem_id, e.Label, t.scores_txt, t.n_codes, t.n_times,
        row_number() OVER (PARTITION BY e.student_id ORDER BY t.end_time NULLS LAST, e.problem_id) AS rn
        FROM early e LEFT JOIN tasks t USING (student_id, problem_id)),
hist AS (SELECT student_id, string_agg(CAST(problem_id AS VARCHAR), ',' ORDER BY rn) AS prev_tasks_id,
        string_agg(coalesce(scores_txt, ''), ';' ORDER BY rn) AS prev_scores,
        string_agg(CAST(NOT Label AS VARCHAR), ',' ORDER BY rn) AS prev_labels,
        coalesce(sum(n_codes), 0) AS n_prev_codes, coalesce(sum(n_times), 0) AS n_prev_times
        FROM et GROUP BY student_id)"""


def _a_inputs(spark, d):
    ev = V.attempts(spark, d).withColumn(
        "zone", F.when(F.col("student_id") % 2 == 1, F.lit("0")).otherwise(F.lit("UTC")))
    e = V.table(spark, d, "events")
    code = e.filter(F.col("event_type") != "signup").select(
        F.col("event_id").alias("code_id"), F.col("props").alias("code"))
    lt = V.attempts(spark, d).groupBy("student_id", "problem_id").agg(
        F.min("ord").alias("o"), F.coalesce(F.max("score") == 100, F.lit(False)).alias("Label"))
    lt = lt.withColumn("k", F.row_number().over(
        Window.partitionBy("student_id").orderBy("o", "problem_id")))
    early = lt.filter(F.col("k") <= N_HIST).select("student_id", "problem_id", "Label")
    late = lt.filter((F.col("k") > N_HIST) & (F.col("k") <= N_LAST)).select("student_id", "problem_id", "Label")
    return ev, code, early, late


@register("prepare_event_log", _fix(with_views(["attempts", "questions"], A_SQL + """
SELECT l.student_id, l.problem_id AS new_task_id, round(t.max_score, 6) AS max_score,
  t.prompt AS new_task, h.prev_tasks_id, h.prev_scores, h.prev_labels,
  CAST(h.n_prev_codes AS BIGINT) AS n_prev_codes, CAST(h.n_prev_times AS BIGINT) AS n_prev_times,
  CAST(NOT l.Label AS BIGINT) AS Label
FROM late l LEFT JOIN tasks t USING (student_id, problem_id) LEFT JOIN hist h USING (student_id)""")))
def q_prepare_event_log(spark, d):
    ev, code, early, late = _a_inputs(spark, d)
    out = H.prepare_event_log(ev, code, early, late, V.questions(spark, d), event_type=None,
                              keys=("student_id", "problem_id"), order=("ord",))
    return finalize(out.select(
        "student_id", "new_task_id", "max_score", "new_task",
        F.array_join("prev_tasks_id", ",").alias("prev_tasks_id"),
        _txt_nested("prev_scores").alias("prev_scores"),
        _txt("prev_labels").alias("prev_labels"),
        _n_nested("prev_tasks").alias("n_prev_codes"),
        _n_nested("all_times").alias("n_prev_times"),
        "Label"))


@register("utc_normalise", """
SELECT event_id, epoch_us(CASE WHEN user_id % 2 = 1 THEN timezone('UTC', timezone('US/Eastern', ts))
  ELSE ts END) AS ts_utc FROM events""")
def q_utc_normalise(spark, d):
    from attemptlog.functions.timefn import normalise_zone
    e = V.table(spark, d, "events").select("event_id", "user_id", "ts")
    z = F.when(F.col("user_id") % 2 == 1, F.lit("0")).otherwise(F.lit("UTC"))
    return finalize(e.select("event_id", normalise_zone(F.col("ts"), z).alias("ts_utc")))


@register("filter_event_type", """
SELECT user_id AS student_id, CAST(count(*) AS BIGINT) AS n_click FROM events
WHERE event_type = 'click' AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL
GROUP BY user_id""")
def q_filter_event_type(spark, d):
    from attemptlog.operators.attempts import drop_incomplete, filter_event_type
    e = V.table(spark, d, "events")
    e = drop_incomplete(filter_event_type(e, "click"), ["user_id", "ts", "value"])
    return finalize(e.groupBy(F.col("user_id").alias("student_id"))
                    .agg(F.count(F.lit(1)).alias("n_click")))


@register("history_long", _fix(with_views(["attempts", "questions"], SUBS_SQL + f"""
SELECT s1.student_id, s1.course_id, CAST(n.row_number AS BIGINT) AS task_number, s1.pos,
  round(s1.score, 6) AS score, CAST(NOT n.Label AS BIGINT) AS struggling
FROM s1 JOIN num n USING (student_id, course_id, problem_id)
WHERE (s1.best_pos IS NULL OR s1.pos <= s1.best_pos) AND n.row_number <= {N_HIST}""")))
def q_history_long(spark, d):
    from attemptlog.operators.attempts import attempt_rows, trim_after_best
    st = b_stages(spark, d)
    rows = trim_after_best(attempt_rows(subs(spark, d), B_KEYS, B_ORDER), "all")
    h = H.history_long(rows, st["numbered"], n_hist=N_HIST)
    return finalize(h.select("student_id", "course_id", "task_number", "pos", "score",
                             (~F.col("Label")).alias("struggling")))
