"""Registered queries for the Python-side jobs (D1-D6) and what consumes them.

Most have no SQL twin (difflib, Python ``ast``, a model, Spark ML), so the
driver records the rows-only check for them; ``tests/`` checks them against brute-force
Python on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import encode as E
from attemptlog.operators import fits as FT
from attemptlog.operators import jobs as D
from attemptlog.operators import metrics as M
from attemptlog.operators import profile as P
from attemptlog.operators import splits as SP
from attemptlog.operators.sequence import sequenced
from attemptlog.plans.q_attempts import deep_summary
from attemptlog.plans.q_text import _rubric_inputs
from attemptlog.plans.registry import finalize, register
from attemptlog.session import cut_lineage
from attemptlog.sources import views as V


def _changes(spark, d, count_headers=False):
    s = V.snapshots(spark, d)
    rows = sequenced(s, ["group_id"], ["ord"], carry=["code", "role"])
    return D.line_changes(rows, "code", "prev_code", count_headers)


@register("line_changes")
def q_line_changes(spark, d):
    c = _changes(spark, d)
    return finalize(c.select("group_id", "pos", "deleted", "inserted", "changed"))


@register("line_changes_literal")
def q_line_changes_literal(spark, d):
    c = _changes(spark, d, count_headers=True)
    return finalize(c.select("group_id", "pos", "deleted", "inserted", "changed"))


@register("line_change_distribution")
def q_line_change_distribution(spark, d):
    c = _changes(spark, d).withColumn("success", (F.col("last_role") == "assistant").cast("long"))
    snaps = V.snapshots(spark, d).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("role", "ord").alias("last_role"))
    tot = snaps.groupBy((F.col("last_role") == "assistant").cast("long").alias("success")) \
               .agg(F.sum("n").alias("n_snapshots"))
    return finalize(P.line_change_distribution(c, tot, by=["success"]))


@register("embed_texts")
def q_embed_texts(spark, d):
    s = V.snapshots(spark, d)
    snippets = s.select("code").filter(F.col("code").isNotNull()).distinct()
    e = D.embed_texts(snippets, dim=64)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return finalize(e.select(F.md5("code").alias("snippet_md5"), F.size("vector").cast("long").alias("dim"),
                             norm.alias("norm")))


def _python_code(spark, d):
    """Python snippets built by Spark from the attempts (one per task)."""
    a = V.attempts(spark, d)
    t = a.groupBy("student_id", "problem_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.min("ord").alias("ord"))
    code = F.format_string(
        "def task_%d(x):\n    total = 0\n    for i in range(%d):\n        if i %% %d == 0:\n"
        "            total += i * x\n    return total + %d\n",
        F.col("problem_id"), F.col("n"), (F.col("best").cast("long") % 7) + 1, F.col("best").cast("long"))
    return t.withColumn("code", code)


@register("ast_paths")
def q_ast_paths(spark, d):
    code = _python_code(spark, d)
    distinct = code.select("code").distinct().withColumn("code_id", F.md5("code"))
    p = D.ast_paths(distinct, "code", ["code_id"])
    return finalize(p.select("code_id", "n_paths", F.md5("RawASTPath").alias("paths_md5")))


# A path table in SQL and in Spark: three consecutive words of a snapshot's text are one
# entry "start,path,end".  A code belongs to the last person who wrote it.
WORDS_SQL = "string_split(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g')), ' ')"
PATHS_SQL = f"""WITH w AS (SELECT text AS code, max(conv_id) AS student_id, {WORDS_SQL} AS ws FROM conversations
  WHERE text IS NOT NULL GROUP BY text),
p AS (SELECT md5(code) AS code_id, student_id, list_transform(range(1, len(ws) - 1),
  lambda i: ws[i] || ',' || ws[i + 1] || ',' || ws[i + 2]) AS es FROM w),
e AS (SELECT code_id, student_id, unnest(es) AS e, generate_subscripts(es, 1) AS k FROM p),
t AS (SELECT code_id, k, string_split(e, ',') AS x FROM e WHERE student_id % 3 <> 0 AND length(trim(e)) > 3),
n AS (SELECT token, count(*) AS c FROM (SELECT x[1] AS token FROM t UNION ALL SELECT x[3] FROM t) GROUP BY token),
h AS (SELECT x[2] AS token, count(*) AS c FROM t GROUP BY token),
nv AS (SELECT token, c, row_number() OVER (ORDER BY c DESC, token) + 1 AS i FROM n),
pv AS (SELECT token, c, row_number() OVER (ORDER BY c DESC, token) + 1 AS i FROM h)"""


def _path_table(spark, d):
    s = V.snapshots(spark, d).filter("code is not null")
    t = s.groupBy("code").agg(F.max("group_id").alias("student_id"))
    ws = F.split(F.trim(F.regexp_replace(F.regexp_replace("code", "[^A-Za-z ]", " "), " +", " ")), " ")
    t = t.withColumn("_w", ws)
    entries = F.transform(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.concat_ws(
        ",", x, F.get("_w", i + 1), F.get("_w", i + 2)))
    return cut_lineage(t.select(F.md5("code").alias("code_id"), "student_id", F.array_join(entries, "@$").alias("RawASTPath")))


def _vocab(spark, d):
    paths = _path_table(spark, d)
    train = paths.filter("student_id % 3 <> 0").select("student_id").distinct()
    nodes, pth = E.path_vocabulary(paths, ["code_id"], train)
    return paths, nodes, pth


@register("path_vocabulary", PATHS_SQL + """
SELECT 'node' AS kind, token, CAST(c AS BIGINT) AS count, CAST(i AS BIGINT) AS index FROM nv
UNION ALL SELECT 'path', token, CAST(c AS BIGINT), CAST(i AS BIGINT) FROM pv""")
def q_path_vocabulary(spark, d):
    _, nodes, paths = _vocab(spark, d)
    out = nodes.withColumn("kind", F.lit("node")).unionByName(paths.withColumn("kind", F.lit("path")))
    return finalize(out.select("kind", "token", "count", "index"))


@register("encode_code_steps", PATHS_SQL + """
, x AS (SELECT e.code_id, e.k, coalesce(a.i, 1) AS s, coalesce(b.i, 1) AS p, coalesce(c.i, 1) AS z
  FROM e LEFT JOIN nv a ON a.token = string_split(e, ',')[1] LEFT JOIN pv b ON b.token = string_split(e, ',')[2]
  LEFT JOIN nv c ON c.token = string_split(e, ',')[3] WHERE e.k <= 100)
SELECT p.code_id, md5(coalesce(string_agg(CAST(s AS VARCHAR) || ' ' || CAST(x.p AS VARCHAR) || ' ' || CAST(z AS VARCHAR), ',' ORDER BY k), ''))
  AS steps_md5, CAST(count(k) AS BIGINT) AS n_paths, CAST(count(*) FILTER (WHERE x.p = 1) AS BIGINT) AS n_unknown
FROM p LEFT JOIN x USING (code_id) GROUP BY p.code_id""")
def q_encode_code_steps(spark, d):
    paths, nodes, pth = _vocab(spark, d)
    enc = E.encode_code_steps(paths, nodes, pth, ["code_id"], max_paths=100)   # once per snippet
    z = F.filter(F.arrays_zip("start_idx", "path_idx", "end_idx"), lambda x: x["path_idx"] != E.PAD)
    txt = F.array_join(F.transform(z, lambda x: F.concat_ws(" ", x["start_idx"].cast("string"), x["path_idx"].cast("string"),
                                                            x["end_idx"].cast("string"))), ",")
    return finalize(enc.select("code_id", F.md5(txt).alias("steps_md5"), F.size(z).cast("long").alias("n_paths"),
                               F.size(F.filter("path_idx", lambda x: x == E.UNK)).cast("long").alias("n_unknown")))


@register("score_rubric")
def q_score_rubric(spark, d):
    a = D.score_rubric(_rubric_inputs(spark, d))
    return finalize(a.select("student_id", "course_id", "position", F.md5("answer").alias("answer_md5")))


FEATURES = ["num_snapshots", "time_to_solve", "mean_gap", "max_gap"]


def _features(spark, d):
    s = deep_summary(spark, d).withColumn("Label", F.col("success").cast("int"))
    labels = SP.student_label(s, order=("problem_id",))
    folds = SP.stratified_folds(labels, k=5, seed=42).select("student_id", "fold")
    x = s.join(folds, "student_id", "inner").na.fill(0, subset=FEATURES)
    for c in FEATURES:
        x = x.withColumn(c, F.col(c).cast("double"))
    return x


@register("fit_struggle")
def q_fit_struggle(spark, d):
    pred = D.fit_struggle(_features(spark, d), FEATURES, fold="fold", max_iter=20)
    per = M.metrics_by_group(pred, 0.5, ["fold"])
    return finalize(per)


@register("tune_struggle")
def q_tune_struggle(spark, d):
    return finalize(D.tune_struggle(_features(spark, d), FEATURES, grid=(0.0, 0.1)))


@register("fit_struggle_models")
def q_fit_struggle_models(spark, d):
    x = cut_lineage(_features(spark, d).select(*FEATURES, "Label", "fold"))
    models = FT.fit_models(x, FEATURES, grid=(0.0, 0.01, 0.1))
    per = M.metrics_by_group(FT.score_held_out(x, models, FEATURES), 0.5, ["fold", "reg"])
    return finalize(per.join(models.select("fold", "reg", "converged"), ["fold", "reg"]))


@register("tune_struggle_models")
def q_tune_struggle_models(spark, d):
    return finalize(FT.tune_models(_features(spark, d), FEATURES, grid=(0.0, 0.01, 0.1)))
