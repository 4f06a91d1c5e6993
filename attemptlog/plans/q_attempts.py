"""Registered queries: attempts, profiling and struggle definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.functions.timefn import seconds_between
from attemptlog.operators import attempts as A
from attemptlog.operators import profile as P
from attemptlog.operators import struggle as S
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.sources import views as V

KEYS = ["student_id", "problem_id"]
# The driver's events are about 1000x sparser in time than the reference's
# logs (median gap 1.4 days instead of minutes), so every time threshold of the
# registered queries is multiplied by TIME_SCALE; library defaults are unscaled.
TIME_SCALE = 1000
NO_BREAK = 600 * TIME_SCALE      # P10 bound (<=)
NB_BREAK = 900 * TIME_SCALE      # K9-K12 bound (<)
LONG_S, SHORT_S = 900 * TIME_SCALE, 300 * TIME_SCALE
ORDER = ["ord"]


def deep_rows(spark, d):
    return A.attempt_rows(V.attempts_deep(spark, d), KEYS, ORDER)


def deep_summary(spark, d):
    return A.summarize_attempts(V.attempts_deep(spark, d), KEYS, ORDER)


def att_summary(spark, d):
    return A.summarize_attempts(V.attempts(spark, d), KEYS, ORDER)


SUMMARY_COLS = """student_id, problem_id, num_snapshots, epoch_us(start_time) AS start_time,
  epoch_us(end_time) AS end_time, round(max_score, 6) AS max_score,
  round(first_score, 6) AS first_score, round(last_score, 6) AS last_score, best_pos, max_gap,
  round(mean_gap, 6) AS mean_gap, CAST(success AS BIGINT) AS success, time_to_solve"""


@register("attempt_summary", with_views(["att_summary"], f"SELECT {SUMMARY_COLS} FROM att_summary"))
def q_attempt_summary(spark, d):
    return finalize(att_summary(spark, d))


@register("attempt_gaps", with_views(["deep_rows"], """
SELECT student_id, problem_id, ord, pos, gap,
  CAST(((gap % 86400) + 86400) % 86400 AS BIGINT) AS gap_wrapped
FROM deep_rows"""))
def q_attempt_gaps(spark, d):
    r = deep_rows(spark, d)
    r = r.withColumn("gap_wrapped", seconds_between(F.col("ts"), F.col("prev_ts"), wrap_day=True))
    return finalize(r.select("student_id", "problem_id", "ord", "pos", "gap", "gap_wrapped"))


@register("time_to_solve", with_views(["deep_summary"], """
SELECT student_id, problem_id, time_to_solve,
  CAST(((time_to_solve % 86400) + 86400) % 86400 AS BIGINT) AS time_to_solve_wrapped,
  round(time_to_solve / 60.0, 6) AS minutes
FROM deep_summary"""))
def q_time_to_solve(spark, d):
    s = A.summarize_attempts(V.attempts_deep(spark, d), KEYS, ORDER)
    s = s.withColumn("time_to_solve_wrapped",
                     seconds_between("end_time", "start_time", wrap_day=True))
    return finalize(s.select("student_id", "problem_id", "time_to_solve",
                             "time_to_solve_wrapped",
                             (F.col("time_to_solve") / 60.0).alias("minutes")))


@register("trim_after_best", with_views(["deep_rows"], """
SELECT student_id, problem_id,
  CAST(count(*) AS BIGINT) AS n_all,
  CAST(count(*) FILTER (WHERE pos <= best_pos) AS BIGINT) AS n_trim,
  epoch_us(max(ts) FILTER (WHERE pos <= best_pos)) AS end_time_trim,
  CAST(count(*) FILTER (WHERE best <> 100 OR pos <= best_pos) AS BIGINT) AS n_code_kept,
  round(max(score), 6) AS max_score
FROM deep_rows GROUP BY student_id, problem_id"""))
def q_trim_after_best(spark, d):
    r = A.trim_after_best(deep_rows(spark, d), "code_if_perfect")
    keep = F.col("pos") <= F.col("best_pos")
    out = r.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(keep).alias("n_trim"),
        F.max(F.when(keep, F.col("ts"))).alias("end_time_trim"),
        F.count_if(F.col("code_kept")).alias("n_code_kept"),
        F.max("score").alias("max_score"))
    return finalize(out)


@register("dataset_profile", with_views(["att_summary"], """
SELECT CAST(sum(num_snapshots) AS BIGINT) AS n_snapshots,
  CAST(count(DISTINCT student_id) AS BIGINT) AS n_students,
  CAST(count(DISTINCT problem_id) AS BIGINT) AS n_problems,
  CAST(count(DISTINCT (student_id, problem_id)) AS BIGINT) AS n_pairs
FROM att_summary"""))
def q_dataset_profile(spark, d):
    return finalize(P.dataset_profile(att_summary(spark, d)))


@register("problems_per_student", with_views(["att_summary"], """
SELECT student_id, CAST(count(DISTINCT problem_id) AS BIGINT) AS n_problems
FROM att_summary GROUP BY student_id"""))
def q_problems_per_student(spark, d):
    return finalize(P.problems_per_student(att_summary(spark, d)))


@register("snapshot_stats", with_views(["deep_summary"], """
SELECT problem_id, CAST(count(DISTINCT student_id) AS BIGINT) AS number_of_students,
  CAST(min(num_snapshots) AS BIGINT) AS min_snapshots,
  CAST(max(num_snapshots) AS BIGINT) AS max_snapshots,
  round(avg(num_snapshots), 6) AS mean_snapshots,
  round(median(num_snapshots), 6) AS median_snapshots
FROM deep_summary GROUP BY problem_id"""))
def q_snapshot_stats(spark, d):
    return finalize(P.snapshot_stats(deep_summary(spark, d)))


@register("time_stats", with_views(["deep_summary"], """
SELECT problem_id, CAST(count(DISTINCT student_id) AS BIGINT) AS number_of_students,
  round(min(time_to_solve / 60.0), 6) AS min_time_to_solve,
  round(max(time_to_solve / 60.0), 6) AS max_time_to_solve,
  round(avg(time_to_solve / 60.0), 6) AS mean_time_to_solve,
  round(quantile_cont(time_to_solve / 60.0, 0.5), 6) AS median_time_to_solve,
  round(avg(mean_gap / 60.0), 6) AS mean_time_between_snapshots,
  round(quantile_cont(mean_gap / 60.0, 0.5), 6) AS median_time_between_snapshots
FROM deep_summary WHERE num_snapshots > 1 GROUP BY problem_id"""))
def q_time_stats(spark, d):
    return finalize(P.time_stats(deep_summary(spark, d)))


@register("success_rate", with_views(["att_summary"], """
SELECT CAST(count(*) FILTER (WHERE success) AS BIGINT) AS n_success,
  CAST(count(*) FILTER (WHERE NOT success) AS BIGINT) AS n_fail,
  round(count(*) FILTER (WHERE NOT success) * 100.0 / count(*), 6) AS fail_rate
FROM att_summary"""))
def q_success_rate(spark, d):
    return finalize(P.success_rate(att_summary(spark, d)))


@register("snapshots_by_outcome", with_views(["deep_summary"], """
SELECT CAST(success AS BIGINT) AS success, CAST(sum(num_snapshots) AS BIGINT) AS n_snapshots
FROM deep_summary GROUP BY 1"""))
def q_snapshots_by_outcome(spark, d):
    return finalize(P.snapshots_by_outcome(deep_summary(spark, d)))


@register("single_attempt_failures", with_views(["att_summary"], """
SELECT CAST(count(*) FILTER (WHERE num_snapshots = 1 AND max_score < 100) AS BIGINT)
  AS n_single_attempt_failures FROM att_summary"""))
def q_single_attempt_failures(spark, d):
    return finalize(P.single_attempt_failures(att_summary(spark, d)))


@register("value_distribution", with_views(["att_summary"], """
SELECT CAST(success AS BIGINT) AS success, num_snapshots, CAST(count(*) AS BIGINT) AS count,
  round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY success), 6) AS share
FROM att_summary GROUP BY success, num_snapshots"""))
def q_value_distribution(spark, d):
    s = att_summary(spark, d).withColumn("success", F.col("success").cast("long"))
    return finalize(P.value_distribution(s, "num_snapshots", by=["success"]))


@register("align_distributions", with_views(["att_summary"], """
, d AS (SELECT success, num_snapshots, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY success) AS share
        FROM att_summary GROUP BY success, num_snapshots)
SELECT coalesce(s.num_snapshots, f.num_snapshots) AS num_snapshots,
  round(coalesce(s.share, 0), 6) AS success_share, round(coalesce(f.share, 0), 6) AS fail_share
FROM (SELECT * FROM d WHERE success) s FULL OUTER JOIN (SELECT * FROM d WHERE NOT success) f
  ON s.num_snapshots = f.num_snapshots""").replace("\n)\n, d AS", "\n),\nd AS"))
def q_align_distributions(spark, d):
    s = att_summary(spark, d)
    ok = P.value_distribution(s.filter(F.col("success")), "num_snapshots")
    bad = P.value_distribution(s.filter(~F.col("success")), "num_snapshots")
    return finalize(P.align_distributions(ok, bad, "num_snapshots",
                                          names=("success_share", "fail_share")))


@register("histogram", with_views(["deep_summary"], """
, r AS (SELECT min(max_score) AS lo, max(max_score) AS hi FROM deep_summary WHERE NOT success),
b AS (SELECT CASE WHEN r.hi = r.lo THEN 0
           ELSE least(floor((s.max_score - r.lo) / ((r.hi - r.lo) / 10)), 9) END AS bin
      FROM deep_summary s, r WHERE NOT s.success),
spine AS (SELECT range AS bin FROM range(10))
SELECT CAST(spine.bin AS BIGINT) AS bin,
  round(r.lo + spine.bin * (r.hi - r.lo) / 10, 6) AS bin_lo,
  round(r.lo + (spine.bin + 1) * (r.hi - r.lo) / 10, 6) AS bin_hi,
  CAST(coalesce((SELECT count(*) FROM b WHERE b.bin = spine.bin), 0) AS BIGINT) AS count
FROM spine, r""").replace("\n)\n, r AS", "\n),\nr AS"))
def q_histogram(spark, d):
    s = deep_summary(spark, d).filter(~F.col("success"))
    return finalize(P.histogram(s, "max_score", bins=10))


def _time_curve(spark, d):
    r = deep_rows(spark, d).filter((F.col("n") > 1) & (F.col("n") >= 10) & (F.col("pos") >= 2))
    r = r.withColumn("pos", F.col("pos") - 1).withColumn("gap_min", F.col("gap") / 60.0)
    return P.position_curve(r, "gap_min")


TIME_CURVE = """, tc AS (SELECT problem_id, pos - 1 AS snapshot, avg(gap / 60.0) AS mean_value,
        count(gap) AS n_students FROM deep_rows WHERE n > 1 AND n >= 10 AND pos >= 2
        GROUP BY problem_id, pos - 1)"""


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


@register("position_curve", _fix(with_views(["deep_rows"], TIME_CURVE + """
SELECT problem_id, CAST(snapshot AS BIGINT) AS snapshot, round(mean_value, 6) AS mean_value,
  CAST(n_students AS BIGINT) AS n_students FROM tc""")))
def q_position_curve(spark, d):
    return finalize(_time_curve(spark, d))


@register("having_support", _fix(with_views(["deep_rows"], TIME_CURVE + """
SELECT problem_id, CAST(snapshot AS BIGINT) AS snapshot, round(mean_value, 6) AS mean_value,
  CAST(n_students AS BIGINT) AS n_students FROM tc WHERE n_students > 10""")))
def q_having_support(spark, d):
    return finalize(P.having_support(_time_curve(spark, d), 10))


@register("curve_min", _fix(with_views(["deep_rows"], TIME_CURVE + """
SELECT problem_id, round(min(mean_value), 6) AS min_value FROM tc WHERE n_students > 10
GROUP BY problem_id""")))
def q_curve_min(spark, d):
    return finalize(P.curve_min(P.having_support(_time_curve(spark, d), 10)))


FAIL_CURVE = """, lastv AS (SELECT *, max(CASE WHEN pos = n THEN score END)
          OVER (PARTITION BY student_id, problem_id) AS last_score FROM deep_rows),
fc AS (SELECT problem_id, pos AS snapshot, avg(score) AS mean_value,
        count(score) AS n_students FROM lastv WHERE last_score <> 100
        GROUP BY problem_id, pos)"""


def _fail_curve(spark, d):
    r = deep_rows(spark, d).filter(F.col("last_score") != 100)
    return P.position_curve(r, "score")


@register("position_curve_overall", _fix(with_views(["deep_rows"], FAIL_CURVE + """
SELECT CAST(snapshot AS BIGINT) AS snapshot, round(avg(mean_value), 6) AS mean_value,
  CAST(sum(n_students) AS BIGINT) AS n_students FROM fc GROUP BY snapshot""")))
def q_position_curve_overall(spark, d):
    return finalize(P.position_curve_overall(_fail_curve(spark, d)))


@register("fail_curve_top10", _fix(with_views(["deep_rows"], FAIL_CURVE + """
, f AS (SELECT * FROM fc WHERE snapshot <= 10 AND n_students >= 5)
SELECT problem_id, CAST(snapshot AS BIGINT) AS snapshot, round(mean_value, 6) AS mean_value,
  CAST(n_students AS BIGINT) AS n_students FROM f
WHERE problem_id IN (SELECT problem_id FROM f GROUP BY problem_id HAVING count(*) = 10)""")
                                       .replace(")\n, f AS", "),\nf AS")))
def q_fail_curve_top10(spark, d):
    c = _fail_curve(spark, d)
    return finalize(P.having_support(c, 5, strict=False, max_snapshot=10, exact_positions=10))


@register("without_breaks", with_views(["deep_summary"], """
SELECT student_id, problem_id, num_snapshots, max_gap, CAST(success AS BIGINT) AS success
FROM deep_summary WHERE num_snapshots > 1 AND max_gap <= {NO_BREAK}""".format(NO_BREAK=NO_BREAK)))
def q_without_breaks(spark, d):
    s = deep_summary(spark, d).filter(F.col("num_snapshots") > 1)
    return finalize(A.without_breaks(s, NO_BREAK, inclusive=True)
                    .select("student_id", "problem_id", "num_snapshots", "max_gap", "success"))


# --------------------------- struggle definitions ---------------------------

def nb_sql(src: str = "deep_summary", bound: str = f"< {NB_BREAK}") -> str:
    """CTEs of the tasks without a break, their baseline and their fastest, over a summary."""
    return f""", nb AS (SELECT * FROM {src} WHERE num_snapshots > 1 AND max_gap {bound}),
base AS (SELECT problem_id, avg(time_to_solve) AS avg_time_to_solve,
    var_samp(time_to_solve) AS variance_time_to_solve,
    stddev_samp(time_to_solve) AS std_dev_time_to_solve,
    avg(num_snapshots) AS avg_attempts, var_samp(num_snapshots) AS variance_num_snapshots,
    stddev_samp(num_snapshots) AS std_dev_num_snapshots FROM nb GROUP BY problem_id),
topn AS (SELECT CAST(floor(avg(s) / 5) AS BIGINT) AS top_n FROM
    (SELECT problem_id, count(DISTINCT student_id) AS s FROM {src} WHERE num_snapshots > 1
     GROUP BY problem_id)),
rk AS (SELECT nb.*, row_number() OVER (PARTITION BY problem_id ORDER BY time_to_solve) AS rt,
    row_number() OVER (PARTITION BY problem_id ORDER BY num_snapshots) AS ra FROM nb),
fast AS (SELECT problem_id,
    sum(CASE WHEN rt <= top_n THEN time_to_solve END) * 1.0 / nullif(count(CASE WHEN rt <= top_n THEN 1 END), 0) AS top_20_time,
    sum(CASE WHEN ra <= top_n THEN num_snapshots END) * 1.0 / nullif(count(CASE WHEN ra <= top_n THEN 1 END), 0) AS top_20_attempts
    FROM rk, topn GROUP BY problem_id)"""


NB = nb_sql()
# dataset B: gaps up to and including 10 minutes, one standard deviation
NB_A, NB_B = nb_sql("att_summary"), nb_sql("att_summary", f"<= {NO_BREAK}")


def _nb(spark, d):
    s = deep_summary(spark, d)
    return s, S.without_break_tasks(s, NB_BREAK, inclusive=False)


@register("problem_baseline", _fix(with_views(["deep_summary"], NB + """
SELECT problem_id, round(avg_time_to_solve, 6) AS avg_time_to_solve,
  round(variance_time_to_solve / 12960000.0, 6) AS variance_time_to_solve_h2,
  round(std_dev_time_to_solve, 6) AS std_dev_time_to_solve, round(avg_attempts, 6) AS avg_attempts,
  round(variance_num_snapshots, 6) AS variance_num_snapshots,
  round(std_dev_num_snapshots, 6) AS std_dev_num_snapshots FROM base""")))
def q_problem_baseline(spark, d):
    _, nb = _nb(spark, d)
    b = S.problem_baseline(nb)
    # variance in hours^2: seconds^2 values near 1e11 cannot carry six decimals
    b = b.withColumn("variance_time_to_solve_h2", F.col("variance_time_to_solve") / 12960000.0)
    return finalize(b.drop("variance_time_to_solve"))


@register("fastest_mean", _fix(with_views(["deep_summary"], NB + """
SELECT problem_id, round(top_20_time, 6) AS top_20_time, round(top_20_attempts, 6) AS top_20_attempts
FROM fast""")))
def q_fastest_mean(spark, d):
    s, nb = _nb(spark, d)
    top = S.fastest_count(s.filter(F.col("num_snapshots") > 1))
    return finalize(S.fastest_mean(nb, top))


@register("baseline_overview", _fix(with_views(["deep_summary"], NB + """
SELECT round(avg(avg_time_to_solve), 6) AS avg_time_to_solve,
  round(avg(std_dev_time_to_solve), 6) AS std_dev_time_to_solve FROM base""")))
def q_baseline_overview(spark, d):
    _, nb = _nb(spark, d)
    return finalize(S.baseline_overview(S.problem_baseline(nb)))


def _att_nb(spark, d, b: bool = False):
    """Summary over (student, problem) and its tasks without a break; dataset B counts
    a task as solved if any attempt is perfect."""
    s = A.summarize_attempts(V.attempts(spark, d), KEYS, ORDER, success="any" if b else "last")
    return s, S.without_break_tasks(s, NO_BREAK if b else NB_BREAK, inclusive=b)


OUTLIERS = """
SELECT nb.student_id, nb.problem_id, nb.time_to_solve FROM nb JOIN base USING (problem_id)
WHERE nb.time_to_solve > base.avg_time_to_solve + {k} * base.std_dev_time_to_solve"""


@register("time_outliers", _fix(with_views(["att_summary"], NB_A + OUTLIERS.format(k=2))))
def q_time_outliers(spark, d):
    _, nb = _att_nb(spark, d)
    out = S.time_outliers(nb, S.problem_baseline(nb), k=2.0)
    return finalize(out.select("student_id", "problem_id", "time_to_solve"))


@register("time_outliers_b", _fix(with_views(["att_summary"], NB_B + OUTLIERS.format(k=1))))
def q_time_outliers_b(spark, d):
    _, nb = _att_nb(spark, d, b=True)
    out = S.time_outliers(nb, S.problem_baseline(nb), k=1.0)
    return finalize(out.select("student_id", "problem_id", "time_to_solve"))


@register("score_failures", with_views(["deep_summary"], """
SELECT student_id, problem_id, num_snapshots, round(max_score, 6) AS max_score
FROM deep_summary WHERE max_score IS DISTINCT FROM 100"""))
def q_score_failures(spark, d):
    out = S.score_failures(deep_summary(spark, d))
    return finalize(out.select("student_id", "problem_id", "num_snapshots", "max_score"))


@register("score_failures_b", _fix(with_views(["att_rows", "att_summary"], NB_B + """
, solved AS (SELECT DISTINCT student_id, problem_id FROM att_rows WHERE score = 100)
SELECT student_id, problem_id, num_snapshots, round(max_score, 6) AS max_score
FROM nb WHERE (student_id, problem_id) NOT IN (SELECT (student_id, problem_id) FROM solved)""")
                                     .replace(")\n, solved AS", "),\nsolved AS")))
def q_score_failures_b(spark, d):
    _, nb = _att_nb(spark, d, b=True)
    out = nb.filter(~F.coalesce("success", F.lit(False)))
    return finalize(out.select("student_id", "problem_id", "num_snapshots", "max_score"))


@register("attempt_outliers", _fix(with_views(["deep_summary"], NB + """
SELECT nb.student_id, nb.problem_id, nb.num_snapshots,
  CAST(nb.num_snapshots > base.variance_num_snapshots + 2 * base.std_dev_num_snapshots AS BIGINT)
    AS literal_rule
FROM nb JOIN base USING (problem_id)
WHERE nb.num_snapshots > base.avg_attempts + 2 * base.std_dev_num_snapshots""")))
def q_attempt_outliers(spark, d):
    _, nb = _nb(spark, d)
    base = S.problem_baseline(nb)
    out = S.attempt_outliers(nb, base, k=2.0)
    lit = out.join(base.select("problem_id", "variance_num_snapshots"), "problem_id") \
        .withColumn("literal_rule", F.col("num_snapshots") >
                    F.col("variance_num_snapshots") + 2 * F.col("std_dev_num_snapshots"))
    return finalize(lit.select("student_id", "problem_id", "num_snapshots", "literal_rule"))


@register("rule_struggle", _fix(with_views(["deep_summary"], NB + """
SELECT nb.student_id, nb.problem_id, nb.time_to_solve, nb.num_snapshots
FROM nb JOIN fast USING (problem_id)
WHERE coalesce(nb.time_to_solve > {LONG_S} OR (nb.time_to_solve > {SHORT_S}
  AND nb.time_to_solve > 2 * fast.top_20_time AND nb.num_snapshots > 3
  AND nb.num_snapshots > 2 * fast.top_20_attempts), false)""".format(LONG_S=LONG_S, SHORT_S=SHORT_S))))
def q_rule_struggle(spark, d):
    s, nb = _nb(spark, d)
    fast = S.fastest_mean(nb, S.fastest_count(s.filter(F.col("num_snapshots") > 1)))
    out = S.rule_struggle(nb, fast, long_s=LONG_S, short_s=SHORT_S)
    return finalize(out.select("student_id", "problem_id", "time_to_solve", "num_snapshots"))


MERGE = """, fails AS (SELECT DISTINCT student_id, problem_id FROM {fails}),
touts AS (SELECT DISTINCT nb.student_id, nb.problem_id FROM nb JOIN base USING (problem_id)
          WHERE nb.time_to_solve > base.avg_time_to_solve + {k} * base.std_dev_time_to_solve),
merged AS (SELECT coalesce(f.student_id, t.student_id) AS student_id,
   coalesce(f.problem_id, t.problem_id) AS problem_id,
   CASE WHEN f.student_id IS NOT NULL AND t.student_id IS NOT NULL THEN 'both'
        WHEN f.student_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge
   FROM fails f FULL OUTER JOIN touts t
   ON f.student_id = t.student_id AND f.problem_id = t.problem_id)"""
MERGE_A = NB_A + MERGE.format(fails="att_summary WHERE max_score IS DISTINCT FROM 100", k=2)
MERGE_B = NB_B + MERGE.format(fails="nb WHERE max_score IS NULL OR max_score < 100", k=1)


def _merged(spark, d, b: bool = False):
    s, nb = _att_nb(spark, d, b)
    fails = nb.filter(~F.coalesce("success", F.lit(False))) if b else S.score_failures(s)
    touts = S.time_outliers(nb, S.problem_baseline(nb), k=1.0 if b else 2.0)
    return (nb if b else s), S.merge_definitions(fails, touts)


@register("merge_definitions", _fix(with_views(["att_summary"], MERGE_A + """
SELECT student_id, problem_id, merge FROM merged""")))
def q_merge_definitions(spark, d):
    return finalize(_merged(spark, d)[1])


@register("merge_definitions_b", _fix(with_views(["att_summary"], MERGE_B + """
SELECT student_id, problem_id, merge FROM merged""")))
def q_merge_definitions_b(spark, d):
    return finalize(_merged(spark, d, b=True)[1])


RATE = """
SELECT CAST((SELECT count(*) FROM merged) AS BIGINT) AS n_struggling,
  CAST(count(*) AS BIGINT) AS n_tasks,
  round((SELECT count(*) FROM merged) * 1.0 / count(*), 6) AS struggle_rate FROM """


@register("struggle_rate", _fix(with_views(["att_summary"], MERGE_A + RATE + "att_summary")))
def q_struggle_rate(spark, d):
    s, m = _merged(spark, d)
    total = s.agg(F.count(F.lit(1)).alias("n_tasks"))
    return finalize(S.struggle_rate(m, total).select("n_struggling", "n_tasks", "struggle_rate"))


@register("struggle_rate_b", _fix(with_views(["att_summary"], MERGE_B + RATE + "nb")))
def q_struggle_rate_b(spark, d):
    nb, m = _merged(spark, d, b=True)
    total = nb.agg(F.count(F.lit(1)).alias("n_tasks"))
    return finalize(S.struggle_rate(m, total).select("n_struggling", "n_tasks", "struggle_rate"))
