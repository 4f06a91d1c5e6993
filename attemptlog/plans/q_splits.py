"""Registered queries: splits, indexes, unions and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import metrics as M
from attemptlog.operators import splits as SP
from attemptlog.plans.q_attempts import att_summary
from attemptlog.plans.registry import finalize, register
from attemptlog.plans.sqlviews import with_views
from attemptlog.session import cut_lineage
from attemptlog.sources import views as V

K = 5
FR = (0.7, 0.1, 0.2)
C1, C2 = FR[0], FR[0] + FR[1]


def _fix(sql):
    return sql.replace("\n)\n, ", "\n),\n")


def _labels(spark, d):
    s = att_summary(spark, d).withColumn("Label", F.col("success").cast("int"))
    return SP.student_label(s, order=("problem_id",))


LABELS_SQL = """, lab AS (SELECT student_id, CAST(arg_min(success, problem_id) AS INTEGER) AS Label
        FROM att_summary GROUP BY student_id),
ln AS (SELECT Label, count(*) AS n FROM lab GROUP BY Label)"""


@register("index_students", """
SELECT student_id, CAST(dense_rank() OVER (ORDER BY student_id) - 1 AS BIGINT) AS student_id_encoded
FROM (SELECT DISTINCT user_id AS student_id FROM events)""")
def q_index_students(spark, d):
    return finalize(SP.index_students(V.attempts(spark, d)))


@register("task_vocabulary", """
SELECT task_id, CAST(dense_rank() OVER (ORDER BY task_id) - 1 AS BIGINT) AS task_index
FROM (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS task_id FROM events
      UNION SELECT DISTINCT p_partkey % 100 FROM part)""")
def q_task_vocabulary(spark, d):
    # Vocabulary over target ids (attempts) union history ids (questions)
    a = V.attempts(spark, d).select(F.col("problem_id").alias("task_id"))
    q = V.questions(spark, d).select(F.col("id").alias("task_id"))
    ids = a.union(q).distinct()
    return finalize(SP.global_rank(ids, ["task_id"], out="task_index"))


@register("student_label", _fix(with_views(["att_summary"], LABELS_SQL + """
SELECT student_id, CAST(Label AS BIGINT) AS Label FROM lab""")))
def q_student_label(spark, d):
    return finalize(_labels(spark, d))


SPLIT_SQL = f""", r AS (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY md5('42:' || student_id), student_id) - 1 AS rk,
        count(*) OVER (PARTITION BY Label) AS n FROM lab),
sp AS (SELECT student_id, Label, rk % {K} AS fold, CASE WHEN rk / n < {C1!r} THEN 'train' WHEN rk / n < {C2!r} THEN 'valid'
        ELSE 'test' END AS split FROM r)"""


@register("stratified_folds", _fix(with_views(["att_summary"], LABELS_SQL + SPLIT_SQL.replace(", r AS", "\n, r AS") + """
SELECT student_id, CAST(Label AS BIGINT) AS Label, CAST(fold AS BIGINT) AS fold FROM sp""").replace(")\n, r AS", "),\nr AS")))
def q_stratified_folds(spark, d):
    return finalize(SP.stratified_folds(_labels(spark, d), k=K, seed=42).select("student_id", "Label", "fold"))


@register("stratified_split", _fix(with_views(["att_summary"], LABELS_SQL + SPLIT_SQL.replace(", r AS", "\n, r AS") + """
SELECT student_id, CAST(Label AS BIGINT) AS Label, split FROM sp""").replace(")\n, r AS", "),\nr AS")))
def q_stratified_split(spark, d):
    return finalize(SP.stratified_split(_labels(spark, d), FR, seed=42).select("student_id", "Label", "split"))


# every seventh student is planted in the test split as well, so the overlap is not empty
PLANTED_SQL = SPLIT_SQL.replace(", r AS", "\n, r AS") + """
, pl AS (SELECT student_id, split FROM sp UNION SELECT student_id, 'test' FROM sp WHERE student_id % 7 = 0)"""


def _planted(spark, d):
    sp = SP.stratified_split(_labels(spark, d), FR, seed=42).select("student_id", "split")
    return cut_lineage(sp.union(sp.filter("student_id % 7 = 0").select("student_id", F.lit("test"))).distinct())


@register("split_overlap", _fix(with_views(["att_summary"], LABELS_SQL + PLANTED_SQL + """
SELECT a.student_id, a.split AS split_a, b.split AS split_b FROM pl a JOIN pl b USING (student_id)
WHERE a.split < b.split""").replace(")\n, r AS", "),\nr AS").replace(")\n, pl AS", "),\npl AS")))
def q_split_overlap(spark, d):
    return finalize(SP.split_overlap(_planted(spark, d)))


@register("split_intersection", _fix(with_views(["att_summary"], LABELS_SQL + PLANTED_SQL + """
SELECT student_id FROM pl WHERE split = 'train' INTERSECT SELECT student_id FROM pl WHERE split = 'test'""")
                                       .replace(")\n, r AS", "),\nr AS").replace(")\n, pl AS", "),\npl AS")))
def q_split_intersection(spark, d):
    pl = _planted(spark, d)
    return finalize(SP.split_intersection(pl.filter("split = 'train'"), pl.filter("split = 'test'")))


@register("split_report", _fix(with_views(["att_summary"], LABELS_SQL + SPLIT_SQL.replace(", r AS", "\n, r AS") + """
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT student_id) AS BIGINT) AS n_students,
  round(avg(CAST(success AS DOUBLE)), 6) AS label_share
FROM att_summary JOIN sp USING (student_id) GROUP BY split""").replace(")\n, r AS", "),\nr AS")))
def q_split_report(spark, d):
    sp = SP.stratified_split(_labels(spark, d), FR, seed=42)
    rows = att_summary(spark, d).withColumn("Label", F.col("success").cast("int"))
    return finalize(SP.split_report(rows, sp))


@register("union_datasets", """
SELECT 'A' AS source, CAST(user_id AS VARCHAR) AS student_id, CAST(NULL AS VARCHAR) AS course_id,
  CAST(count(*) AS BIGINT) AS n_rows FROM events GROUP BY user_id
UNION ALL
SELECT 'B', CAST(o_custkey AS VARCHAR), o_orderpriority, CAST(count(*) AS BIGINT)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderpriority""")
def q_union_datasets(spark, d):
    a = V.attempts(spark, d).groupBy(F.col("student_id").cast("string").alias("student_id")) \
        .agg(F.count(F.lit(1)).alias("n_rows")).withColumn("source", F.lit("A"))
    b = V.attempts_big(spark, d).groupBy(F.col("student_id").cast("string").alias("student_id"),
                                         "course_id") \
        .agg(F.count(F.lit(1)).alias("n_rows")).withColumn("source", F.lit("B"))
    out = SP.union_datasets(a, b)
    return finalize(out.select("source", "student_id", "course_id", "n_rows"))


@register("merged_training", """
WITH a AS (SELECT user_id % 5 AS fold FROM events),
b AS (SELECT o_custkey % 5 AS fold FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'train' AS part, CAST(dataset AS BIGINT) AS dataset, CAST(count(*) AS BIGINT) AS n_rows FROM
  (SELECT 0 AS dataset FROM a WHERE fold <> 0 UNION ALL SELECT 1 FROM b WHERE fold <> 0) GROUP BY dataset
UNION ALL
SELECT 'test', CAST(dataset AS BIGINT), CAST(count(*) AS BIGINT) FROM
  (SELECT 0 AS dataset FROM a WHERE fold = 0 UNION ALL SELECT 1 FROM b WHERE fold = 0) GROUP BY dataset""")
def q_merged_training(spark, d):
    a = V.attempts(spark, d).withColumn("fold", F.col("student_id") % 5).select("student_id", "fold")
    b = V.attempts_big(spark, d).withColumn("fold", F.col("student_id") % 5) \
        .select("student_id", "course_id", "fold")
    tr, te = SP.merged_training(a, b, fold=0)
    t1 = tr.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part", F.lit("train"))
    t2 = te.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part", F.lit("test"))
    return finalize(t1.unionByName(t2).select("part", "dataset", "n_rows"))


# --------------------------------- metrics ---------------------------------

THR = 0.5
CM = f"""WITH p AS (SELECT * FROM predictions),
cm AS (SELECT fold,
  count(*) FILTER (WHERE y_true <> 1 AND NOT y_prob > {THR}) AS tn,
  count(*) FILTER (WHERE y_true <> 1 AND y_prob > {THR}) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND NOT y_prob > {THR}) AS fn,
  count(*) FILTER (WHERE y_true = 1 AND y_prob > {THR}) AS tp FROM p GROUP BY fold),
cls AS (SELECT fold, (tp + tn) * 1.0 / (tp + tn + fp + fn) AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM cm),
sc AS (SELECT fold, y_prob, CAST(sum(y_true) AS BIGINT) AS pos, CAST(sum(1 - y_true) AS BIGINT) AS neg
       FROM p GROUP BY fold, y_prob),
nb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY y_prob
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM sc),
auc AS (SELECT fold, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
        ELSE sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS roc_auc FROM nb GROUP BY fold),
br AS (SELECT fold, avg((y_prob - y_true) ^ 2) AS brier FROM p GROUP BY fold),
allm AS (SELECT * FROM cls JOIN auc USING (fold) JOIN br USING (fold))
"""


def _pred(spark, d):
    return V.predictions(spark, d)


@register("confusion_matrix", with_views(["predictions"], CM.replace("WITH p AS", ", p AS") + """
SELECT fold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
  CAST(tp AS BIGINT) AS tp FROM cm""").replace("\n)\n, p AS", "\n),\np AS"))
def q_confusion_matrix(spark, d):
    return finalize(M.confusion_matrix(_pred(spark, d), THR, ["fold"]))


def _m_sql(body):
    return with_views(["predictions"], CM.replace("WITH p AS", ", p AS") + body) \
        .replace("\n)\n, p AS", "\n),\np AS")


@register("classification_metrics", _m_sql("""
SELECT fold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cls"""))
def q_classification_metrics(spark, d):
    return finalize(M.classification_metrics(_pred(spark, d), THR, ["fold"]))


@register("roc_auc", _m_sql("SELECT fold, round(roc_auc, 6) AS roc_auc FROM auc"))
def q_roc_auc(spark, d):
    return finalize(M.roc_auc(_pred(spark, d), ["fold"]))


@register("brier", _m_sql("SELECT fold, round(brier, 6) AS brier FROM br"))
def q_brier(spark, d):
    return finalize(M.brier(_pred(spark, d), ["fold"]))


@register("metrics_by_fold", _m_sql("""
SELECT round(avg(roc_auc), 6) AS roc_auc, round(avg(accuracy), 6) AS accuracy,
  round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
  round(avg(brier), 6) AS brier FROM allm"""))
def q_metrics_by_fold(spark, d):
    per = M.metrics_by_group(_pred(spark, d), THR, ["fold"])
    return finalize(M.average_over_groups(per))


@register("metrics_by_dataset", _m_sql("""
, pd AS (SELECT dataset AS fold, y_true, y_prob FROM predictions)""".replace(
    "\n, pd AS", "") + "").replace("WITH predictions AS", "WITH predictions0 AS") if False else
    with_views(["predictions"], ", p AS (SELECT dataset AS fold, y_true, y_prob FROM predictions)" +
               CM[CM.index("cm AS") - 1:] + """
SELECT fold AS dataset, round(roc_auc, 6) AS roc_auc, round(accuracy, 6) AS accuracy,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(brier, 6) AS brier FROM allm""").replace("\n)\n, p AS", "\n),\np AS").replace(
        "FROM predictions)\ncm AS", "FROM predictions),\ncm AS"))
def q_metrics_by_dataset(spark, d):
    p = _pred(spark, d)
    return finalize(M.metrics_by_group(p, THR, ["dataset"]))


ROC = """, pts0 AS (SELECT fold, y_prob, pos, neg,
    sum(pos) OVER (PARTITION BY fold ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
    sum(neg) OVER (PARTITION BY fold ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps,
    row_number() OVER (PARTITION BY fold ORDER BY y_prob DESC) AS idx FROM sc),
corner AS (SELECT *, (lead(fps) OVER w - 2 * fps + lag(fps) OVER w) <> 0
      OR (lead(tps) OVER w - 2 * tps + lag(tps) OVER w) <> 0 AS c
      FROM pts0 WINDOW w AS (PARTITION BY fold ORDER BY idx)),
pts AS (SELECT fold, y_prob, tps, fps, idx FROM corner WHERE c IS NULL OR c
        UNION ALL SELECT DISTINCT fold, 'inf'::DOUBLE, 0, 0, 0 FROM sc),
tot AS (SELECT fold, max(tps) AS P, max(fps) AS N FROM pts GROUP BY fold)"""


@register("roc_curve", _m_sql(ROC + """
SELECT fold, CAST(idx AS BIGINT) AS idx, y_prob AS threshold,
  round(CASE WHEN N = 0 THEN NULL ELSE fps * 1.0 / N END, 6) AS fpr,
  round(CASE WHEN P = 0 THEN NULL ELSE tps * 1.0 / P END, 6) AS tpr
FROM pts JOIN tot USING (fold)"""))
def q_roc_curve(spark, d):
    return finalize(M.roc_curve(_pred(spark, d), ["fold"]))


@register("youden_threshold", _m_sql("""
, pts0 AS (SELECT fold, y_prob, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps,
      row_number() OVER (PARTITION BY fold ORDER BY y_prob DESC) AS idx FROM sc
      WINDOW w AS (PARTITION BY fold ORDER BY y_prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT fold, max(tps) AS P, max(fps) AS N FROM pts0 GROUP BY fold HAVING max(tps) > 0 AND max(fps) > 0),
j AS (SELECT fold, y_prob, idx, tps * 1.0 / P - fps * 1.0 / N AS J FROM pts0 JOIN tot USING (fold)
      UNION ALL SELECT fold, 'inf'::DOUBLE, 0, 0.0 FROM tot),
best AS (SELECT fold, max(J) AS mj FROM j GROUP BY fold)
SELECT fold, round(arg_min(y_prob, idx), 6) AS threshold, round(max(mj), 6) AS J
FROM j JOIN best USING (fold) WHERE J = mj GROUP BY fold"""))
def q_youden_threshold(spark, d):
    p = _pred(spark, d)
    both = p.groupBy("fold").agg(F.min("y_true").alias("a"), F.max("y_true").alias("b")) \
            .filter(F.col("a") != F.col("b")).select("fold")
    return finalize(M.youden_threshold(p.join(both, "fold", "left_semi"), ["fold"]))


@register("predict_threshold", """
SELECT doc_id, CAST(y_prob > 0.4 AS BIGINT) AS y_pred_b, CAST(y_prob > 0.25 AS BIGINT) AS y_pred_a
FROM (SELECT l.doc_id, (d.n_chars % 1000) / 1000.0 AS y_prob FROM labels l JOIN documents d USING (doc_id))""")
def q_predict_threshold(spark, d):
    p = M.predict(M.predict(_pred(spark, d), 0.4, out="y_pred_b"), 0.25, out="y_pred_a")
    return finalize(p.select("doc_id", "y_pred_b", "y_pred_a"))
