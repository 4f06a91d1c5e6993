"""Registered queries: concepts, skill vectors and task similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import concepts as C
from attemptlog.operators import history as H
from attemptlog.operators import skills as SK
from attemptlog.plans.q_history import N_HIST, N_LAST, SUBS_SQL, _b_numbered, b_stages
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.sources import views as V
from attemptlog.sources.schema import CONCEPT_MAP, CONCEPTS

SIZE = len(CONCEPTS)


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


def _rollup_sql(dataset="falcon"):
    cols = []
    for c in CONCEPTS:
        flags = CONCEPT_MAP[dataset].get(c, [])
        if not flags:
            e = "0"
        elif len(flags) == 1:
            e = f'coalesce("{flags[0]}", 0)'
        else:
            e = "greatest(" + ", ".join(f'coalesce("{f}", 0)' for f in flags) + ")"
        cols.append(f'CAST({e} AS DOUBLE) AS "{c}"')
    return "SELECT id, " + ", ".join(cols) + " FROM questions"


ROLLUP = f", rollup AS ({_rollup_sql()})"
RC = ", rc AS (SELECT id, unnest([" + ", ".join(f'"{c}"' for c in CONCEPTS) + \
    "]) AS v, generate_subscripts([" + ", ".join(f'"{c}"' for c in CONCEPTS) + "], 1) - 1 AS j FROM rollup)"


def rollup(spark, d):
    return C.rollup_concepts(V.questions(spark, d), "falcon")


@register("rollup_concepts", _fix(with_views(["questions"], ROLLUP + """
SELECT id, """ + ", ".join(f'"{c}"' for c in CONCEPTS) + " FROM rollup")))
def q_rollup_concepts(spark, d):
    return finalize(rollup(spark, d).drop("concepts"))


@register("rollup_concepts_a", _fix(with_views(["questions_a"], ", rollup AS (" +
                                               _rollup_sql("codeworkout").replace("FROM questions", "FROM questions_a")
                                               + ")\nSELECT id, " + ", ".join(f'"{c}"' for c in CONCEPTS)
                                               + " FROM rollup")))
def q_rollup_concepts_a(spark, d):
    r = C.rollup_concepts(V.questions(spark, d, flags="A"), "codeworkout")
    return finalize(r.drop("concepts"))


@register("attach_concepts", _fix(with_views(["attempts", "questions"], SUBS_SQL + ROLLUP + f"""
SELECT n.student_id, n.course_id, CAST(n.row_number - 1 AS BIGINT) AS k,
  CAST(n.problem_id AS VARCHAR) AS task_id,
  """ + " || ".join(f'CAST(CAST(r."{c}" AS INTEGER) AS VARCHAR)' for c in CONCEPTS) + f""" AS bits
FROM num n JOIN rollup r ON n.problem_id = r.id WHERE n.row_number <= {N_HIST}""")))
def q_attach_concepts(spark, d):
    early, _ = H.early_late(_b_numbered(spark, d), N_HIST, N_LAST)
    h = H.build_history(early)
    h = C.attach_concepts(h, rollup(spark, d), ["student_id", "course_id"], pad_to=None, size=SIZE)
    ex = h.select("student_id", "course_id", "prev_tasks_id",
                  F.posexplode("prev_comp_cons").alias("k", "vec"))
    return finalize(ex.select(
        "student_id", "course_id", "k", F.col("prev_tasks_id")[F.col("k")].alias("task_id"),
        F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), "").alias("bits")))


SKILLS_SQL = SUBS_SQL + ROLLUP + RC + f"""
, fin AS (SELECT n.student_id, n.course_id, n.problem_id AS new_task_id FROM num n
        JOIN hist h USING (student_id, course_id)
        WHERE n.row_number > {N_HIST} AND n.row_number <= {N_LAST} AND h.num_tasks = {N_HIST}),
hl AS (SELECT student_id, course_id, problem_id, max_score AS last_score FROM num WHERE row_number <= {N_HIST}),
g AS (SELECT range AS j FROM range({SIZE})),
raw AS (SELECT f.student_id, f.course_id, f.new_task_id, g.j,
        coalesce(sum(rc.v * hl.last_score), 0) AS x
        FROM fin f CROSS JOIN g
        LEFT JOIN hl ON hl.student_id = f.student_id AND hl.course_id = f.course_id
        LEFT JOIN rc ON rc.id = hl.problem_id AND rc.j = g.j
        GROUP BY f.student_id, f.course_id, f.new_task_id, g.j),
rng AS (SELECT j, min(x) AS lo, max(x) AS hi FROM raw GROUP BY j),
sc AS (SELECT raw.*, (x - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END AS y
       FROM raw JOIN rng USING (j)),
mn AS (SELECT student_id, course_id, new_task_id, avg(y) AS m FROM sc GROUP BY ALL),
fv AS (SELECT sc.*, CASE WHEN y > 0 THEN y ELSE m END AS z FROM sc JOIN mn
       USING (student_id, course_id, new_task_id))"""


GROUP = ["student_id", "course_id"]


def _targets(stages):
    """Target rows of people with a full history, and those histories."""
    early, late = H.early_late(stages["numbered"], N_HIST, N_LAST)
    full = stages["history"].filter(F.col("num_tasks") == N_HIST)
    late = late.join(full.select(*GROUP), GROUP, "left_semi")
    return early, late, full.join(late.select(*GROUP).distinct(), GROUP, "left_semi")


def _skills(spark, d, stages=None):
    """Skill vector per target.  It depends on the history alone, so it is computed on
    one row a student and course and attached to the targets last."""
    _, late, hist = _targets(stages or b_stages(spark, d))
    hist = C.attach_concepts(hist, rollup(spark, d), GROUP, pad_to=N_HIST, size=SIZE)
    skills = SK.skills_vector(hist, size=SIZE, n=N_HIST).select(*GROUP, "skills_vec")
    return late.select(*GROUP, F.col("problem_id").alias("new_task_id")).join(skills, GROUP, "inner")


def _similar(spark, d, stages):
    early, late, _ = _targets(stages)
    early = early.join(late.select(*GROUP).distinct(), GROUP, "left_semi")
    return SK.task_similarity(late, early, V.vectors(spark, d))


@register("skills_vector", _fix(with_views(["attempts", "questions"], SKILLS_SQL + """
SELECT student_id, course_id, new_task_id, """ + ", ".join(
    f"round(max(z) FILTER (WHERE j = {j}), 6) AS s{j}" for j in range(SIZE)) + """
FROM fv GROUP BY student_id, course_id, new_task_id""")))
def q_skills_vector(spark, d):
    s = _skills(spark, d)
    return finalize(s.select("student_id", "course_id", "new_task_id",
                             *[F.col("skills_vec")[j].alias(f"s{j}") for j in range(SIZE)]))


SIM_SQL = SUBS_SQL + f"""
, vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
sim AS (SELECT n.student_id, n.course_id, n.problem_id AS target_id, p.problem_id AS prev_id,
        p.row_number AS position, list_cosine_similarity(a.vec, b.vec) AS similarity
        FROM num n JOIN hist h USING (student_id, course_id)
        JOIN num p ON p.student_id = n.student_id AND p.course_id = n.course_id AND p.row_number <= {N_HIST}
        LEFT JOIN vec a ON a.id = n.problem_id LEFT JOIN vec b ON b.id = p.problem_id
        WHERE n.row_number > {N_HIST} AND n.row_number <= {N_LAST} AND h.num_tasks = {N_HIST})"""


@register("task_similarity", _fix(with_views(["attempts", "questions"], SIM_SQL + """
SELECT student_id, course_id, target_id, prev_id, CAST(position AS BIGINT) AS position,
  round(similarity, 6) AS similarity FROM sim""")))
def q_task_similarity(spark, d):
    out = _similar(spark, d, b_stages(spark, d))
    return finalize(out.select("student_id", "course_id", "target_id", "prev_id", "position", "similarity"))


WEIGHTED_SQL = SIM_SQL + ROLLUP + RC + f"""
, g AS (SELECT range AS j FROM range({SIZE})),
raw AS (SELECT sim.student_id, sim.course_id, sim.target_id AS new_task_id, g.j,
        coalesce(sum(rc.v * hl.max_score * coalesce(sim.similarity, 0)), 0) AS x
        FROM sim CROSS JOIN g
        JOIN num hl ON hl.student_id = sim.student_id AND hl.course_id = sim.course_id AND hl.row_number = sim.position
        LEFT JOIN rc ON rc.id = sim.prev_id AND rc.j = g.j
        GROUP BY sim.student_id, sim.course_id, sim.target_id, g.j),
rng AS (SELECT j, min(x) AS lo, max(x) AS hi FROM raw GROUP BY j),
sc AS (SELECT raw.*, (x - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END AS y FROM raw JOIN rng USING (j)),
mn AS (SELECT student_id, course_id, new_task_id, avg(y) AS m FROM sc GROUP BY ALL)"""


@register("skills_vector_similarity", _fix(with_views(["attempts", "questions"], WEIGHTED_SQL + """
SELECT sc.student_id, sc.course_id, sc.new_task_id, """ + ", ".join(
    f"round(max(CASE WHEN y > 0 THEN y ELSE m END) FILTER (WHERE j = {j}), 6) AS s{j}" for j in range(SIZE)) + """
FROM sc JOIN mn USING (student_id, course_id, new_task_id) GROUP BY ALL""")))
def q_skills_vector_similarity(spark, d):
    st = b_stages(spark, d)
    _, _, hist = _targets(st)
    hist = C.attach_concepts(hist, rollup(spark, d), GROUP, pad_to=N_HIST, size=SIZE)
    rows = SK.similarity_arrays(_similar(spark, d, st)).join(hist, GROUP, "inner")
    s = SK.skills_vector(rows, size=SIZE, n=N_HIST, similarity="similarities")
    return finalize(s.select("student_id", "course_id", F.col("target_id").alias("new_task_id"),
                             *[F.col("skills_vec")[j].alias(f"s{j}") for j in range(SIZE)]))


EXAMPLE_SQL = """
, te AS (SELECT student_id, course_id, count(*) AS task_num,
        string_agg(CAST(num_snapshots AS VARCHAR), ',' ORDER BY row_number) AS snaps,
        string_agg(CAST(CAST(NOT Label AS INTEGER) AS VARCHAR), ',' ORDER BY row_number) AS labs
        FROM num WHERE row_number <= 30 GROUP BY student_id, course_id),
sid AS (SELECT student_id, dense_rank() OVER (ORDER BY student_id) - 1 AS idx FROM (SELECT DISTINCT student_id FROM fin))"""


@register("training_examples_full", _fix(with_views(["attempts", "questions"], SKILLS_SQL + EXAMPLE_SQL + """
SELECT f.student_id, f.course_id, f.new_task_id, CAST(te.task_num AS BIGINT) AS task_num,
  te.snaps AS snaps_per_task, te.labs AS labels_padded,
  """ + " || ".join(f'CAST(CAST(r."{c}" AS INTEGER) AS VARCHAR)' for c in CONCEPTS) + """ AS features,
  """ + ", ".join(f"round(max(z) FILTER (WHERE j = {j}), 6) AS skill{j}" for j in range(SIZE)) + """,
  CAST(sid.idx AS BIGINT) AS student_id_encoded, CAST(1 AS BIGINT) AS dataset,
  CAST(NOT n.Label AS BIGINT) AS label
FROM fin f JOIN te USING (student_id, course_id) JOIN sid USING (student_id)
JOIN rollup r ON r.id = f.new_task_id JOIN fv USING (student_id, course_id, new_task_id)
JOIN num n ON n.student_id = f.student_id AND n.course_id = f.course_id AND n.problem_id = f.new_task_id
GROUP BY ALL""")))
def q_training_examples_full(spark, d):
    # Every part of one training row except the text tokens and code vectors, which are joins on ids
    from attemptlog.operators import encode as E
    from attemptlog.operators import splits as SP
    from attemptlog.operators.attempts import dataset_flag, invert_labels
    st = b_stages(spark, d)
    _, late, hist = _targets(st)
    parts = E.training_examples(invert_labels(hist, scalars=()), GROUP, n_tasks=N_HIST)
    rows = late.select(*GROUP, F.col("problem_id").alias("new_task_id"), (~F.col("Label")).alias("label"))
    rows = rows.join(parts, GROUP, "inner").join(_skills(spark, d, st), [*GROUP, "new_task_id"], "inner")
    con = rollup(spark, d).select(F.col("id").alias("new_task_id"), F.col("concepts").alias("curr_comp_cons"))
    rows = rows.join(con, "new_task_id", "inner").join(SP.index_students(late), "student_id", "inner")
    rows = dataset_flag(rows)
    return finalize(rows.select(
        *GROUP, "new_task_id", F.col("task_num").cast("long").alias("task_num"),
        F.array_join("snaps_per_task", ",").alias("snaps_per_task"), F.array_join("labels_padded", ",").alias("labels_padded"),
        F.array_join(F.transform("curr_comp_cons", lambda x: x.cast("int").cast("string")), "").alias("features"),
        *[F.col("skills_vec")[j].alias(f"skill{j}") for j in range(SIZE)],
        "student_id_encoded", "dataset", "label"))
