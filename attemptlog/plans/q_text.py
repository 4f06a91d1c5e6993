"""Registered queries: text lookups, constructs and rubric answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.functions.catalogues import HTML, JAVA_RAW, JAVA_SHARED, JAVA_SHARED_FLAGS, PYTHON_RAW
from attemptlog.functions.textfn import clean_prompt, lower_ids
from attemptlog.operators import constructs as K
from attemptlog.operators import history as H
from attemptlog.operators import joins as J
from attemptlog.operators import rubric as R
from attemptlog.operators import skills as SK
from attemptlog.operators.attempts import first_per_key
from attemptlog.plans.q_features import SIZE, _skills
from attemptlog.plans.q_history import N_HIST, N_LAST, SUBS_SQL, b_stages
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.sources import views as V
from attemptlog.sources.schema import FLAGS_A, FLAGS_B


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


# ------------------------------- F1 / F2 / W7 -------------------------------

@register("clean_prompt", """
SELECT doc_id, lower(source) AS source_id, md5(text) AS prompt_md5, length(text) AS n_chars
FROM documents""")
def q_clean_prompt(spark, d):
    doc = V.table(spark, d, "documents")
    raw = F.concat(F.col("lang"), F.lit(" PROBLEM STATEMENT: "), F.col("text"), F.lit(" \n"))
    c = clean_prompt(raw)
    return finalize(doc.select("doc_id", lower_ids(F.upper("source")).alias("source_id"),
                               F.md5(c).alias("prompt_md5"), F.length(c).cast("long").alias("n_chars")))


@register("first_per_key", """
SELECT md5(text) AS text_key, min(doc_id) AS first_doc_id, CAST(count(*) AS BIGINT) AS n_copies
FROM documents GROUP BY text""")
def q_first_per_key(spark, d):
    doc = V.table(spark, d, "documents").select("doc_id", "text")
    first = first_per_key(doc, ["text"], ["doc_id"])
    n = doc.groupBy("text").agg(F.count(F.lit(1)).alias("n_copies"))
    out = first.join(n, "text").select(F.md5("text").alias("text_key"),
                                       F.col("doc_id").alias("first_doc_id"), "n_copies")
    return finalize(out)


# ------------------------------- J1 / J9 / J16 -------------------------------

@register("with_code_only", """
SELECT user_id AS student_id, CAST(count(*) AS BIGINT) AS n_with_code FROM events
WHERE event_id IN (SELECT doc_id FROM documents) GROUP BY user_id""")
def q_with_code_only(spark, d):
    a = V.attempts(spark, d)
    code = V.code_states(spark, d)
    out = J.with_code_only(a, code)
    return finalize(out.groupBy("student_id").agg(F.count(F.lit(1)).alias("n_with_code")))


@register("unknown_questions", """
SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS problem_id FROM events
WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) NOT IN (SELECT DISTINCT p_partkey % 40 FROM part)""")
def q_unknown_questions(spark, d):
    a = V.attempts(spark, d)
    return finalize(J.unknown_questions(a, V.questions(spark, d, n=40)).select("problem_id").distinct())


@register("attach_snapshots", """
WITH c AS (SELECT conv_id * 1000 + turn AS code_id, conv_id, turn, text FROM conversations)
SELECT conv_id AS group_id, CAST(count(*) AS BIGINT) AS n_snapshots,
  CAST(sum(length(text)) AS BIGINT) AS n_chars,
  md5(string_agg(text, chr(1) ORDER BY turn)) AS texts_md5
FROM c GROUP BY conv_id""")
def q_attach_snapshots(spark, d):
    s = V.snapshots(spark, d).withColumn("code_id", F.col("group_id") * 1000 + F.col("ord"))
    ids = s.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("ord", "code_id"))).alias("_a")) \
           .select("group_id", F.transform("_a", lambda x: x["code_id"]).alias("code_ids"))
    code = s.select("code_id", "code")
    out = J.attach_snapshots(ids, code, ["group_id"], "code_ids", out="snapshots")
    return finalize(out.select(
        "group_id", F.size("snapshots").cast("long").alias("n_snapshots"),
        F.aggregate("snapshots", F.lit(0).cast("long"),
                    lambda a, x: a + F.length(x).cast("long")).alias("n_chars"),
        F.md5(F.array_join("snapshots", "\u0001")).alias("texts_md5")))


@register("distinct_snippets", """
SELECT md5(text) AS snippet_md5, length(text) AS n_chars FROM (SELECT DISTINCT text FROM conversations)""")
def q_distinct_snippets(spark, d):
    from attemptlog.operators.jobs import distinct_snippets
    s = V.snapshots(spark, d)
    hist = s.groupBy("group_id").agg(F.collect_list("code").alias("codes")) \
            .select(F.array("codes").alias("prev_tasks"))
    out = distinct_snippets(hist, "prev_tasks")
    return finalize(out.select(F.md5("code").alias("snippet_md5"),
                               F.length("code").cast("long").alias("n_chars")))


# ------------------------------- constructs -------------------------------

HTML_FLAGS = list(HTML)
# required HTML construct i of a page = raw question flag i of question page_id % 100
HTML_FLAG_SOURCE = dict(zip(HTML_FLAGS, FLAGS_B))


def _pages(spark, d):
    p = V.table(spark, d, "pages")
    return p.select("page_id", (F.col("page_id") % 100).alias("problem_id"),
                    (F.col("page_id") % 4 != 0).cast("long").alias("success"),
                    F.col("html").alias("final_text"))


def _html_questions(spark, d):
    q = V.questions(spark, d)
    return q.select("id", *[F.col(f"`{src}`").alias(n) for n, src in HTML_FLAG_SOURCE.items()])


def _pages_missing(spark, d, keep_all=False):
    return K.missing_constructs(_pages(spark, d), _html_questions(spark, d), HTML, HTML_FLAGS,
                                keep_all=keep_all)


_MISS_ITEMS = " || ".join(
    f"CASE WHEN q.\"{src}\" = 1 AND NOT regexp_matches(p.html, '(?is){pat}') THEN '{n},' ELSE '' END"
    for (n, pat), src in zip(HTML.items(), FLAGS_B))
PAGES_SQL = f""", pm AS (SELECT p.page_id, p.page_id % 100 AS problem_id,
        CAST(p.page_id % 4 <> 0 AS BIGINT) AS success, rtrim({_MISS_ITEMS}, ',') AS missing
        FROM pages p JOIN questions q ON p.page_id % 100 = q.id)"""


@register("missing_constructs", _fix(with_views(["questions"], PAGES_SQL + """
SELECT page_id, success, missing FROM pm WHERE missing <> ''""")))
def q_missing_constructs(spark, d):
    m = _pages_missing(spark, d)
    return finalize(m.select("page_id", "success", F.array_join("missing", ",").alias("missing")))


@register("missing_construct_share", _fix(with_views(["questions"], PAGES_SQL + """
, ex AS (SELECT success, unnest(string_split(missing, ',')) AS construct FROM pm WHERE missing <> ''),
c AS (SELECT success, construct, count(*) AS cnt FROM ex GROUP BY success, construct)
SELECT success, construct, CAST(cnt AS BIGINT) AS count,
  round(cnt * 1.0 / sum(cnt) OVER (PARTITION BY success), 6) AS share FROM c""")
                                               .replace(")\n, ex AS", "),\nex AS")))
def q_missing_construct_share(spark, d):
    return finalize(K.missing_construct_share(_pages_missing(spark, d)))


@register("missing_rate", _fix(with_views(["questions"], PAGES_SQL + """
SELECT success, CAST(count(*) AS BIGINT) AS n_tasks,
  CAST(count(*) FILTER (WHERE missing <> '') AS BIGINT) AS n_missing,
  round(avg(CASE WHEN missing <> '' THEN 1.0 ELSE 0.0 END), 6) AS missing_rate
FROM pm GROUP BY success""")))
def q_missing_rate(spark, d):
    return finalize(K.missing_rate(_pages_missing(spark, d, keep_all=True)))


@register("missing_constructs_python")
def q_missing_constructs_python(spark, d):
    # reference Python catalogue (literal), whole documents, flags of question source id
    doc = V.table(spark, d, "documents")
    lab = V.table(spark, d, "labels").select("doc_id", F.col("quality").alias("success"))
    t = doc.join(lab, "doc_id", "left").select(
        "doc_id", F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("problem_id"),
        F.coalesce("success", F.lit(0)).alias("success"), F.col("text").alias("final_text"))
    m = K.missing_constructs(t, V.questions(spark, d), PYTHON_RAW, FLAGS_B, keep_all=True)
    return finalize(K.missing_rate(m))


@register("missing_constructs_java")
def q_missing_constructs_java(spark, d):
    # reference Java catalogues: raw flags, then the concepts shared with Python
    c = V.snapshots(spark, d)
    last = first_per_key(c.withColumn("neg", -F.col("ord")), ["group_id"], ["neg"])
    t = last.select("group_id", (F.col("group_id") % 100).alias("problem_id"),
                    (F.col("role") == "assistant").cast("long").alias("success"),
                    F.col("code").alias("final_text"))
    qa = V.questions(spark, d, flags="A")
    raw = K.missing_constructs(t, qa, JAVA_RAW, FLAGS_A, keep_all=True)
    shared = K.missing_constructs(t, K.merge_flags(qa, JAVA_SHARED_FLAGS), JAVA_SHARED,
                                  list(JAVA_SHARED_FLAGS), keep_all=True)
    a = K.missing_rate(raw).withColumn("catalogue", F.lit("raw"))
    b = K.missing_rate(shared).withColumn("catalogue", F.lit("shared"))
    return finalize(a.unionByName(b))


# ------------------------------- rubric -------------------------------

def _hist(spark, d, stages=None):
    numbered = (stages or b_stages(spark, d))["numbered"]
    early, _ = H.early_late(numbered, N_HIST, N_LAST)
    return H.build_history(early)


def _rubric_inputs(spark, d, stages=None):
    return R.build_rubric_inputs(_hist(spark, d, stages), V.questions(spark, d), which="last")


def _answers(spark, d, stages=None):
    from attemptlog.operators.jobs import score_rubric
    return score_rubric(_rubric_inputs(spark, d, stages))


RUBRIC_SQL = SUBS_SQL + """
, lc AS (SELECT student_id, course_id, problem_id, arg_max(code_id, pos) AS last_code
        FROM s1 WHERE best_pos IS NULL OR pos <= best_pos GROUP BY ALL),
ri AS (SELECT n.student_id, n.course_id, CAST(n.row_number - 1 AS BIGINT) AS position,
        CAST(n.problem_id AS VARCHAR) AS task_id,
        'Task:' || chr(10) || trim(q.prompt) || chr(10) || 'Student code:' || chr(10)
          || CAST(lc.last_code AS VARCHAR) AS prompt
        FROM num n JOIN lc USING (student_id, course_id, problem_id)
        JOIN questions q ON n.problem_id = q.id WHERE n.row_number <= 30),
rsc AS (SELECT *, length(prompt) AS L, (length(prompt) // 2) % 4 AS style FROM ri),
pr AS (SELECT *, CASE WHEN style = 3 THEN NULL ELSE CAST(L % 5 + 1 AS DOUBLE) END AS decomposition,
        CASE WHEN style = 3 THEN NULL ELSE CAST((L // 5) % 5 + 1 AS DOUBLE) END AS alg,
        CASE WHEN style = 3 THEN NULL ELSE CAST((L // 25) % 5 + 1 AS DOUBLE) END AS reading
        FROM rsc)"""


@register("build_rubric_inputs", _fix(with_views(["attempts", "questions"], RUBRIC_SQL + """
SELECT student_id, course_id, position, task_id, md5(prompt) AS prompt_md5 FROM ri""")))
def q_build_rubric_inputs(spark, d):
    r = _rubric_inputs(spark, d)
    return finalize(r.select("student_id", "course_id", "position", "task_id",
                             F.md5("prompt").alias("prompt_md5")))


@register("parse_rubric", _fix(with_views(["attempts", "questions"], RUBRIC_SQL + """
SELECT student_id, course_id, CAST(count(*) AS BIGINT) AS n_answers,
  string_agg(coalesce(CAST(CAST(decomposition AS BIGINT) AS VARCHAR), ''), ',' ORDER BY position) AS decomposition,
  string_agg(coalesce(CAST(CAST(alg AS BIGINT) AS VARCHAR), ''), ',' ORDER BY position) AS alg,
  string_agg(coalesce(CAST(CAST(reading AS BIGINT) AS VARCHAR), ''), ',' ORDER BY position) AS reading
FROM pr GROUP BY student_id, course_id""")))
def q_parse_rubric(spark, d):
    parsed = R.parse_rubric(_answers(spark, d))
    per = R.collect_rubric(parsed)

    def txt(c):
        return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("long").cast("string"),
                                                                  F.lit(""))), ",")
    return finalize(per.select("student_id", "course_id", F.size("decomposition").cast("long").alias("n_answers"),
                               txt("decomposition").alias("decomposition"), txt("alg").alias("alg"),
                               txt("reading").alias("reading")))


@register("rubric_retries", _fix(with_views(["attempts", "questions"], RUBRIC_SQL + """
SELECT student_id, course_id, position FROM pr WHERE style = 3""")))
def q_rubric_retries(spark, d):
    parsed = R.parse_rubric(_answers(spark, d))
    return finalize(R.rubric_retries(parsed).select("student_id", "course_id", "position"))


@register("skill_averages", _fix(with_views(["attempts", "questions"], RUBRIC_SQL + """
SELECT student_id, course_id, round(avg(decomposition / 5), 6) AS dec_avg, round(avg(alg / 5), 6) AS alg_avg,
  round(avg(reading / 5), 6) AS read_avg FROM pr GROUP BY student_id, course_id""")))
def q_skill_averages(spark, d):
    per = R.collect_rubric(R.parse_rubric(_answers(spark, d)))
    return finalize(SK.rubric_averages(per).select("student_id", "course_id", "dec_avg", "alg_avg", "read_avg"))


def _ext_sql():
    from attemptlog.plans.q_features import SKILLS_SQL
    rub = RUBRIC_SQL[len(SUBS_SQL):]          # the rubric CTEs after the shared prefix
    return _fix(with_views(["attempts", "questions"], SKILLS_SQL + rub + """
, av AS (SELECT student_id, course_id, avg(decomposition / 5) AS dec_avg, avg(alg / 5) AS alg_avg,
        avg(reading / 5) AS read_avg FROM pr GROUP BY student_id, course_id)
SELECT f.student_id, f.course_id, f.new_task_id, """ + ", ".join(
        f"round(max(fv.z) FILTER (WHERE fv.j = {j}), 6) AS s{j}" for j in range(SIZE)) + """,
  round(any_value(av.dec_avg), 6) AS dec_avg, round(any_value(av.alg_avg), 6) AS alg_avg, round(any_value(av.read_avg), 6) AS read_avg
FROM fin f JOIN fv USING (student_id, course_id, new_task_id) LEFT JOIN av USING (student_id, course_id)
GROUP BY f.student_id, f.course_id, f.new_task_id""").replace(")\n, av AS", "),\nav AS"))


@register("extend_with_rubric", _ext_sql())
def q_extend_with_rubric(spark, d):
    st = b_stages(spark, d)                      # one K2 build for both inputs
    per = R.collect_rubric(R.parse_rubric(_answers(spark, d, st)))
    ext = SK.extend_with_rubric(_skills(spark, d, st), per)
    return finalize(ext.select("student_id", "course_id", "new_task_id",
                               *[F.col("skills_vec")[j].alias(f"s{j}") for j in range(SIZE)],
                               *[F.col("skills_vec")[SIZE + k].alias(c)
                                 for k, c in enumerate(("dec_avg", "alg_avg", "read_avg"))]))
