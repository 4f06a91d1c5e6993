"""Registered queries: sequence encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import encode as E
from attemptlog.operators import history as H
from attemptlog.operators.attempts import invert_labels
from attemptlog.plans.q_history import N_HIST, N_LAST, SUBS_SQL, b_stages
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.session import cut_lineage

GROUP = ["student_id", "course_id"]
ROW = [*GROUP, "new_task_id"]
PAD_ATTEMPTS = 765
L_TASKS, L_ATTEMPTS, L_STEPS = 100, 100, 50


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


def _base(spark, d):
    """Target rows with the encoded history.  Ids are mapped on the histories (one
    row a student and course) before a history is repeated for its targets."""
    st = b_stages(spark, d)
    early, late = H.early_late(st["numbered"], N_HIST, N_LAST)
    late = late.select(*GROUP, F.col("problem_id").alias("new_task_id"))
    vocab = cut_lineage(E.task_vocabulary(late, st["history"]))
    hist = invert_labels(st["history"].filter(F.col("num_tasks") == N_HIST), scalars=())
    hist = E.map_array(hist, GROUP, "prev_tasks_id", vocab, out="prev_q")
    tq = vocab.select(F.col("task_id").alias("_t"), F.col("task_index").alias("target_q"))
    out = late.join(hist, GROUP, "inner")
    out = out.join(tq, out["new_task_id"].cast("string") == tq["_t"], "left").drop("_t")
    return out.crossJoin(vocab.agg(F.count(F.lit(1)).alias("N")))


ENC_SQL = SUBS_SQL + f"""
, voc AS (SELECT task_id, dense_rank() OVER (ORDER BY task_id) AS task_index FROM
        (SELECT DISTINCT CAST(problem_id AS VARCHAR) AS task_id FROM num WHERE row_number <= {N_LAST})),
nv AS (SELECT count(*) AS N FROM voc),
fin AS (SELECT n.student_id, n.course_id, n.problem_id AS new_task_id, v.task_index AS target_q
        FROM num n JOIN hist h USING (student_id, course_id)
        JOIN voc v ON CAST(n.problem_id AS VARCHAR) = v.task_id
        WHERE n.row_number > {N_HIST} AND n.row_number <= {N_LAST} AND h.num_tasks = {N_HIST}),
hs AS (SELECT n.student_id, n.course_id, n.row_number AS k, v.task_index AS q, NOT n.Label AS lab,
        n.num_snapshots AS m FROM num n JOIN voc v ON CAST(n.problem_id AS VARCHAR) = v.task_id
        WHERE n.row_number <= {N_HIST}),
ex AS (SELECT hs.*, g.s, row_number() OVER (PARTITION BY student_id, course_id ORDER BY k, g.s) AS tt,
        CASE WHEN g.s < hs.m THEN hs.q + nv.N WHEN hs.lab THEN hs.q ELSE hs.q + nv.N END AS code
        FROM hs CROSS JOIN nv, generate_series(1, hs.m) AS g(s)),
ext AS (SELECT *, count(*) OVER (PARTITION BY student_id, course_id) AS tot FROM ex),
k17 AS (SELECT student_id, course_id, max(tot) AS tot,
        repeat('0,', greatest({L_ATTEMPTS} - max(tot), 0)) ||
          string_agg(CAST(code AS VARCHAR), ',' ORDER BY tt) FILTER (WHERE tt > tot - {L_ATTEMPTS}) AS codes,
        repeat('0,', greatest({L_ATTEMPTS} - max(tot), 0)) ||
          string_agg(CAST(CASE WHEN code > (SELECT N FROM nv) THEN code - (SELECT N FROM nv) ELSE code END AS VARCHAR),
                     ',' ORDER BY tt) FILTER (WHERE tt > tot - {L_ATTEMPTS}) AS decoded
        FROM ext GROUP BY student_id, course_id)"""


@register("encode_tasks", _fix(with_views(["attempts", "questions"], ENC_SQL + """
SELECT f.student_id, f.course_id, f.new_task_id,
  string_agg(CAST(hs.q AS VARCHAR), ',' ORDER BY hs.k) AS task_seq,
  string_agg(CAST(CAST(hs.lab AS INTEGER) AS VARCHAR), ',' ORDER BY hs.k) AS label_seq
FROM fin f JOIN hs USING (student_id, course_id) GROUP BY ALL""")))
def q_encode_tasks(spark, d):
    e = E.encode_tasks(_base(spark, d), q="prev_q")
    return finalize(e.select(*ROW, F.array_join("task_seq", ",").alias("task_seq"),
                             F.array_join("label_seq", ",").alias("label_seq")))


@register("encode_attempts", _fix(with_views(["attempts", "questions"], ENC_SQL + f"""
, pa AS (SELECT student_id, course_id, sum(m) AS total,
        string_agg(repeat(CAST(q AS VARCHAR) || ',', CAST(m AS BIGINT)), '' ORDER BY k) AS qs,
        string_agg(repeat('0,', CAST(m - 1 AS BIGINT)) || CAST(CAST(lab AS INTEGER) AS VARCHAR) || ',', '' ORDER BY k) AS ls
        FROM hs GROUP BY student_id, course_id)
SELECT f.student_id, f.course_id, f.new_task_id, CAST(pa.total AS BIGINT) AS n_attempts,
  md5(rtrim(pa.qs || repeat('0,', CAST({PAD_ATTEMPTS} - pa.total AS BIGINT)), ',')) AS attempt_q_md5,
  md5(rtrim(pa.ls || repeat('0,', CAST({PAD_ATTEMPTS} - pa.total AS BIGINT)), ',')) AS attempt_labels_md5
FROM fin f JOIN pa USING (student_id, course_id)""").replace(")\n, pa AS", "),\npa AS")))
def q_encode_attempts(spark, d):
    e = E.encode_attempts(_base(spark, d), pad=PAD_ATTEMPTS, q="prev_q")
    n = F.aggregate(E.snapshots_per_task("prev_scores"), F.lit(0).cast("long"), lambda a, x: a + x)
    return finalize(e.select(*ROW, n.alias("n_attempts"),
                             F.md5(F.array_join("attempt_q", ",")).alias("attempt_q_md5"),
                             F.md5(F.array_join("attempt_labels", ",")).alias("attempt_labels_md5")))


@register("encode_interactions", _fix(with_views(["attempts", "questions"], ENC_SQL + f"""
, hc AS (SELECT hs.*, count(*) OVER (PARTITION BY student_id, course_id) AS cnt,
        CASE WHEN lab THEN q ELSE q + (SELECT N FROM nv) END AS code FROM hs)
SELECT f.student_id, f.course_id, f.new_task_id,
  repeat('0,', greatest({L_TASKS} - max(hc.cnt), 0)) ||
    string_agg(CAST(hc.code AS VARCHAR), ',' ORDER BY hc.k) FILTER (WHERE hc.k > hc.cnt - {L_TASKS})
    AS interactions
FROM fin f JOIN hc USING (student_id, course_id) GROUP BY ALL""").replace(")\n, hc AS", "),\nhc AS")))
def q_encode_interactions(spark, d):
    b = _base(spark, d)
    e = E.encode_interactions(b, F.col("N"), L_TASKS, q="prev_q")
    return finalize(e.select(*ROW, F.array_join("interactions", ",").alias("interactions")))


@register("encode_interactions_attempts", _fix(with_views(["attempts", "questions"], ENC_SQL + """
SELECT f.student_id, f.course_id, f.new_task_id, k17.codes AS interactions
FROM fin f JOIN k17 USING (student_id, course_id)""")))
def q_encode_interactions_attempts(spark, d):
    e = E.encode_interactions(_base(spark, d), F.col("N"), L_ATTEMPTS, q="prev_q", per_attempt=True)
    return finalize(e.select(*ROW, F.array_join("interactions", ",").alias("interactions")))


@register("positions", _fix(with_views(["attempts", "questions"], ENC_SQL + f"""
SELECT f.student_id, f.course_id, f.new_task_id,
  array_to_string(range(CAST(greatest({L_ATTEMPTS} - k17.tot, 0) AS BIGINT), {L_ATTEMPTS}), ',') AS positions
FROM fin f JOIN k17 USING (student_id, course_id)""")))
def q_positions(spark, d):
    e = E.encode_interactions(_base(spark, d), F.col("N"), L_ATTEMPTS, q="prev_q", per_attempt=True)
    e = E.positions(e)
    return finalize(e.select(*ROW, F.array_join("positions", ",").alias("positions")))


@register("decode_interactions", _fix(with_views(["attempts", "questions"], ENC_SQL + """
SELECT f.student_id, f.course_id, f.new_task_id, k17.decoded AS decoded,
  substr(k17.decoded, strpos(k17.decoded, ',') + 1) || ',' || CAST(f.target_q AS VARCHAR) AS decoded_shifted
FROM fin f JOIN k17 USING (student_id, course_id)""")))
def q_decode_interactions(spark, d):
    e = E.encode_interactions(_base(spark, d), F.col("N"), L_ATTEMPTS, q="prev_q", per_attempt=True)
    e = E.decode_interactions(e, F.col("N"))
    return finalize(e.select(*ROW, F.array_join("decoded", ",").alias("decoded"),
                             F.array_join("decoded_shifted", ",").alias("decoded_shifted")))


@register("one_hot_target", _fix(with_views(["attempts", "questions"], ENC_SQL + """
SELECT f.student_id, f.course_id, f.new_task_id, CAST(nv.N + 1 AS BIGINT) AS width,
  CAST(f.target_q AS VARCHAR) AS ones
FROM fin f CROSS JOIN nv""")))
def q_one_hot_target(spark, d):
    e = E.one_hot_target(_base(spark, d), F.col("N"))     # the width is a column: no extra job
    return finalize(e.select(*ROW, F.size("target_one_hot").cast("long").alias("width"),
                             F.array_join(F.filter(F.transform("target_one_hot", lambda x, i: F.when(x == 1, i)),
                                                   lambda i: i.isNotNull()), ",").alias("ones")))


@register("training_examples", _fix(with_views(["attempts", "questions"], ENC_SQL + """
, te AS (SELECT student_id, course_id, count(*) AS task_num,
        string_agg(CAST(m AS VARCHAR), ',' ORDER BY k) AS snaps,
        string_agg(CAST(CAST(lab AS INTEGER) AS VARCHAR), ',' ORDER BY k) AS labs
        FROM hs GROUP BY student_id, course_id)
SELECT f.student_id, f.course_id, f.new_task_id, CAST(te.task_num AS BIGINT) AS task_num,
  te.snaps || repeat(',1', CAST(30 - te.task_num AS BIGINT)) AS snaps_per_task,
  te.labs || repeat(',0', CAST(30 - te.task_num AS BIGINT)) AS labels_padded
FROM fin f JOIN te USING (student_id, course_id)""").replace(")\n, te AS", "),\nte AS")))
def q_training_examples(spark, d):
    t = E.training_examples(_base(spark, d), ROW, n_tasks=30)
    return finalize(t.select(*ROW, F.col("task_num").cast("long").alias("task_num"),
                             F.array_join("snaps_per_task", ",").alias("snaps_per_task"),
                             F.array_join("labels_padded", ",").alias("labels_padded")))


@register("code_step_rows", _fix(with_views(["attempts", "questions"], ENC_SQL + f"""
, cs AS (SELECT s1.student_id, s1.course_id, s1.code_id, row_number() OVER w AS tt,
        count(*) OVER (PARTITION BY s1.student_id, s1.course_id) AS tot,
        CASE WHEN hs.lab AND s1.pos = max(s1.pos) OVER (PARTITION BY s1.student_id, s1.course_id, s1.problem_id) THEN hs.q
             ELSE hs.q + nv.N END AS interaction
        FROM s1 JOIN num n USING (student_id, course_id, problem_id)
        JOIN hs ON hs.student_id = n.student_id AND hs.course_id = n.course_id AND hs.k = n.row_number CROSS JOIN nv
        WHERE (s1.best_pos IS NULL OR s1.pos <= s1.best_pos) AND n.row_number <= {N_HIST}
        WINDOW w AS (PARTITION BY s1.student_id, s1.course_id ORDER BY n.row_number, s1.pos))
SELECT f.student_id, f.course_id, f.new_task_id, CAST(tt - tot + {L_STEPS - 1} AS BIGINT) AS step,
  CAST(interaction AS BIGINT) AS interaction, code_id AS code
FROM fin f JOIN cs USING (student_id, course_id) WHERE tt > tot - {L_STEPS}""").replace(")\n, cs AS", "),\ncs AS")))
def q_code_step_rows(spark, d):
    r = E.code_step_rows(_base(spark, d), ROW, F.col("N"), L_STEPS)
    return finalize(r.select(*ROW, "step", "interaction", "code"))
