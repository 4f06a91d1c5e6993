"""Registered queries: file sources and sinks written from the given tables and read back, and plain projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlog.functions.timefn import parse_time
from attemptlog.operators import attempts as A
from attemptlog.operators import skills as SK
from attemptlog.operators import splits as SP
from attemptlog.plans.registry import finalize, register
from attemptlog.session import scratch_path
from attemptlog.sources import files as S
from attemptlog.sources import views as V
from attemptlog.sources.schema import EVENT_LOG


# -- S1, S9, U1: course folders with drifting columns and bad records ------------------------------
def _courses(spark, d):
    """events as event logs of three courses: one in the schema's order, one in another with a further
    column, one without a section; some records get a text where a number belongs or a field too many."""
    e = V.table(spark, d, "events").select(
        F.col("event_id").alias("Order"), F.col("user_id").cast("string").alias("SubjectID"),
        F.lit("sec, 1").alias("CourseSectionID"), F.col("event_type").alias("EventType"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ServerTimestamp"), F.lit("UTC").alias("ServerTimezone"),
        (F.col("user_id") % 7).cast("double").alias("AssignmentID"),
        F.when(F.col("event_id") % 97 == 5, F.concat(F.lit("p"), F.col("event_id").cast("string")))
        .otherwise((F.col("event_id") % 50).cast("string")).alias("ProblemID"),
        F.lit(None).cast("string").alias("CodeStateID"), F.floor("value").cast("double").alias("Score"), F.lit("x").alias("Note"))
    names = [f.name for f in EVENT_LOG.fields]
    order = {"c0": names, "c1": [*reversed(names), "Note"], "c2": [n for n in names if n != "CourseSectionID"]}
    root, out = scratch_path(spark, "courses"), {}
    for k, (course, columns) in enumerate(order.items()):
        out[course] = f"{root}/{course}"
        e.filter(F.col("Order") % 3 == k).select(*columns).write.option("header", True).option("escape", '"').csv(out[course])
    return S.scan_courses(spark, out)


_GOOD = """SELECT event_id AS "Order", user_id::VARCHAR AS "SubjectID",
  CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'sec, 1' END AS "CourseSectionID", event_type AS "EventType",
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS "ServerTimestamp", 'UTC' AS "ServerTimezone", (user_id % 7)::DOUBLE AS "AssignmentID",
  event_id % 50 AS "ProblemID", NULL::VARCHAR AS "CodeStateID", floor(value)::DOUBLE AS "Score",
  'c' || (event_id % 3)::VARCHAR AS course FROM events WHERE event_id % 97 <> 5"""


@register("scan_courses", _GOOD)
def q_scan_courses(spark, d):
    return finalize(S.good_rows(_courses(spark, d)))


@register("scan_quarantine", """
SELECT 'c' || (event_id % 3)::VARCHAR AS course, contains(bad, 'p' || event_id::VARCHAR) AS named, event_id AS ord
FROM (SELECT event_id, 'p' || event_id::VARCHAR AS bad FROM events WHERE event_id % 97 = 5)""")
def q_scan_quarantine(spark, d):
    bad = S.quarantine(_courses(spark, d))
    told = F.regexp_extract(S.BAD_RECORD, r"(?:^|,)p(\d+)(?:,|$)", 1).cast("long")
    return bad.select("course", told.isNotNull().alias("named"), told.alias("ord"))


# -- S2, S3, S6, S7, S8: written and read back --------------------------------------------------------
@register("questions_file", "SELECT lower('P' || p_partkey::VARCHAR) AS id, p_name AS prompt FROM part")
def q_questions_file(spark, d):
    path = scratch_path(spark, "questions")
    V.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
                                     F.col("p_name").alias("prompt")).write.option("header", True).option("escape", '"').csv(path)
    return S.read_questions(spark, path, T._parse_datatype_string("id string, prompt string"), lower_id="id")


@register("paths_file", """SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS "SubjectID", md5(text) AS code_md5,
  md5(role || ',up,' || conv_id::VARCHAR) AS paths_md5 FROM conversations""")
def q_paths_file(spark, d):
    path = scratch_path(spark, "paths")
    S.write_paths(V.table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("SubjectID"), F.col("text").alias("Code"),
        F.concat(F.col("role"), F.lit(",up,"), F.col("conv_id").cast("string")).alias("RawASTPath")), path)
    back = S.read_paths(spark, path)
    return back.select("SubjectID", F.md5("Code").alias("code_md5"), F.md5("RawASTPath").alias("paths_md5"))


@register("split_file", "SELECT DISTINCT user_id AS student_id, user_id % 5 AS fold FROM events")
def q_split_file(spark, d):
    path = scratch_path(spark, "split")
    S.save_split(V.table(spark, d, "events").select(F.col("user_id").alias("student_id"), (F.col("user_id") % 5).alias("fold")).distinct(), path)
    return finalize(S.load_split(spark, path))


@register("predictions_file", """SELECT l.doc_id, quality::DOUBLE AS y_true, round((n_chars % 1000) / 1000.0, 6) AS y_prob
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def q_predictions_file(spark, d):
    path = scratch_path(spark, "predictions")
    S.write_predictions(V.predictions(spark, d).select("doc_id", "y_true", "y_prob"), path)
    return finalize(spark.read.schema("doc_id long, y_true double, y_prob double").option("header", True).csv(path))


@register("skill_scores_file", """SELECT user_id::VARCHAR AS student_id, event_id % 5 AS d0, NULL::BIGINT AS d1, event_id % 3 AS d2,
  2::BIGINT AS n_alg, 0::BIGINT AS n_reading FROM events WHERE event_id % 20 = 0""")
def q_skill_scores_file(spark, d):
    path = scratch_path(spark, "scores")
    text = F.concat(F.lit("["), (F.col("event_id") % 5).cast("string"), F.lit(", None, "), (F.col("event_id") % 3).cast("string"), F.lit("]"))
    V.table(spark, d, "events").filter("event_id % 20 = 0").select(
        F.col("user_id").cast("string").alias("student_id"), text.alias("decomposition"), F.lit("[1.0, 4.5]").alias("alg"),
        F.lit("[]").alias("reading")).write.option("header", True).option("escape", '"').csv(path)
    back = S.read_skill_scores(spark, path)
    got = [F.col("decomposition")[k].cast("long").alias(f"d{k}") for k in range(3)]
    return finalize(back.select("student_id", *got, F.size("alg").alias("n_alg"), F.size("reading").alias("n_reading")))


# -- P4, P6, P12, P13, F3, F13: projections -----------------------------------------------------------
@register("common_names", """SELECT l_orderkey AS student_id, l_linenumber::BIGINT AS problem_id,
  l_orderkey::DOUBLE::VARCHAR || ' ' || l_linenumber::VARCHAR AS problem_key,
  CASE WHEN l_quantity = 50 THEN 1::BIGINT ELSE 0::BIGINT END AS correct FROM lineitem""")
def q_common_names(spark, d):
    t = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    t = A.to_common_names(t, {"l_orderkey": "student_id", "l_linenumber": "problem_id", "l_quantity": "score", "not there": "x"})
    t = A.problem_key(A.binarize_score(t, 50.0), "student_id", "problem_id")
    return finalize(t.select("student_id", "problem_id", "problem_key", "correct"))


@register("parsed_times", """SELECT event_id, epoch_us(date_trunc('second', ts)) AS ts, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 4 END AS flag
FROM events""")
def q_parsed_times(spark, d):
    e = V.table(spark, d, "events")
    text = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
                    F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4).alias("flag"))
    return finalize(A.fill_zero(text, ["flag"]).select("event_id", parse_time("t").alias("ts"), "flag"))


@register("latent_columns", """SELECT vec_id, len(embedding) + 3 AS size, round(embedding[1]::DOUBLE, 6) AS first, 1.0::DOUBLE AS last
FROM embeddings""")
def q_latent_columns(spark, d):
    v = V.table(spark, d, "embeddings").select("vec_id", F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("cons"))
    out = v.select("vec_id", SK.append_latents("cons", 3)[0].alias("row"))
    return finalize(out.select("vec_id", F.size("row").alias("size"), F.col("row")[0].alias("first"), F.element_at("row", -1).alias("last")))


@register("course_union", """SELECT o_orderkey AS student_id, o_orderpriority AS course_id FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def q_course_union(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("student_id"), F.col("o_orderpriority").alias("course_id"))
    return finalize(SP.union_courses([o.filter(F.col("course_id") == c) for c in ("1-URGENT", "2-HIGH", "5-LOW")]))
