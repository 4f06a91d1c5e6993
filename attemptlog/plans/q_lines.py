"""Registered queries of the line alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlog.operators import lines as L
from attemptlog.operators import profile as P
from attemptlog.operators.sequence import sequenced
from attemptlog.plans.registry import finalize, register
from attemptlog.sources import views as V

# The whole table of the longest common subsequence, a row of the old text at a time: a row's
# entry is the greatest of the entry above and of the one above to the left plus one if the lines are equal.
_SPLIT = r"string_split_regex(coalesce({}, ''), '\r\n|[\n\x0B\f\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
_LINES = "CASE WHEN {0}[-1] = '' THEN {0}[:-2] ELSE {0} END"
ALIGN_SQL = f"""WITH RECURSIVE s AS (
  SELECT conv_id AS group_id, row_number() OVER w AS pos, text AS code, lag(text) OVER w AS prev_code,
    last_value(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_role
  FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)),
raw AS (SELECT *, {_SPLIT.format('prev_code')} AS x, {_SPLIT.format('code')} AS y FROM s WHERE pos > 1),
pairs AS (SELECT group_id, pos, last_role, {_LINES.format('x')} AS a, {_LINES.format('y')} AS b FROM raw),
lcs(group_id, pos, k, best) AS (
  SELECT group_id, pos, 0::BIGINT, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) FROM pairs
  UNION ALL
  SELECT group_id, pos, k + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j])) FROM (
    SELECT l.group_id, l.pos, l.k, list_transform(range(1, len(l.best) + 1), lambda j: greatest(l.best[j],
      CASE WHEN j > 1 AND p.b[j - 1] = p.a[l.k + 1] THEN l.best[j - 1] + 1 ELSE 0 END)) AS cand
    FROM lcs l JOIN pairs p ON p.group_id = l.group_id AND p.pos = l.pos WHERE l.k < len(p.a)) AS n),
counts AS (SELECT p.group_id, p.pos, p.last_role, len(p.a) - l.best[-1] AS deleted, len(p.b) - l.best[-1] AS inserted
  FROM pairs p JOIN lcs l ON p.group_id = l.group_id AND p.pos = l.pos AND l.k = len(p.a))"""


def _changes(spark, d, carry=()):
    rows = sequenced(V.snapshots(spark, d), ["group_id"], ["ord"], carry=["code", "role"]).filter("pos > 1")
    return L.fewest_line_changes(rows, ["group_id", "pos"], carry=carry)


@register("fewest_line_changes", ALIGN_SQL + """
SELECT group_id, pos, deleted::BIGINT AS deleted, inserted::BIGINT AS inserted, greatest(deleted, inserted)::BIGINT AS changed
FROM counts""")
def q_fewest_line_changes(spark, d):
    return finalize(_changes(spark, d).select("group_id", "pos", "deleted", "inserted", "changed"))


@register("fewest_line_change_distribution", ALIGN_SQL + """,
tot AS (SELECT (last_role = 'assistant')::BIGINT AS success, count(*) AS n FROM s GROUP BY 1),
long AS (SELECT (last_role = 'assistant')::BIGINT AS success, 'deleted' AS kind, deleted::BIGINT AS n_lines FROM counts
  UNION ALL SELECT (last_role = 'assistant')::BIGINT, 'inserted', inserted::BIGINT FROM counts)
SELECT success, kind, n_lines, count(*) AS "count", round(count(*) / any_value(n)::DOUBLE, 6) AS share
FROM long JOIN tot USING (success) GROUP BY success, kind, n_lines""")
def q_fewest_line_change_distribution(spark, d):
    success = (F.col("last_role") == "assistant").cast("long").alias("success")
    changes = _changes(spark, d, carry=["last_role"]).withColumn("success", success)
    s = sequenced(V.snapshots(spark, d), ["group_id"], ["ord"], carry=["role"])
    totals = s.groupBy(success).agg(F.count(F.lit(1)).alias("n_snapshots"))
    return finalize(P.line_change_distribution(changes, totals, by=["success"]))
