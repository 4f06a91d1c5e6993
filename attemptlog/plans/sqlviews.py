"""The views of ``attemptlog.sources.views`` written as DuckDB CTEs.

``with_views(names, body)`` prepends the CTEs a query needs (in dependency
order) to an oracle query body.
"""

from __future__ import annotations

from attemptlog.sources.schema import FLAGS_A, FLAGS_B

_SCORE = "CAST(CASE WHEN isnan({e}) THEN NULL ELSE {e} END AS DOUBLE)"


def _flags_sql(names):
    return ",\n    ".join(
        f"CAST(max(CASE WHEN p_size = {j + 1} AND p_type IN ('ECONOMY','PROMO') THEN 1 ELSE 0 END)"
        f" AS INTEGER) AS \"{n}\"" for j, n in enumerate(names))


def _seq(src: str, keys: str, order: str) -> str:
    # plain-window twin of operators.sequence.sequenced + attempt_rows
    return f"""SELECT *,
    row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos,
    count(*) OVER (PARTITION BY {keys}) AS n,
    lag(ts) OVER (PARTITION BY {keys} ORDER BY {order}) AS prev_ts,
    max(score) OVER (PARTITION BY {keys}) AS best
  FROM {src}"""


def _bestpos(src: str, keys: str) -> str:
    return f"""SELECT *,
    min(CASE WHEN score = best THEN pos END) OVER (PARTITION BY {keys}) AS best_pos,
    CAST(floor((epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0) AS BIGINT) AS gap
  FROM {src}"""


def _summary(src: str, keys: str, success: str) -> str:
    succ = ("max(CASE WHEN pos = n THEN score END) = 100" if success == "last"
            else "max(score) >= 100")
    return f"""SELECT {keys},
    CAST(count(*) AS BIGINT) AS num_snapshots,
    arg_min(ts, pos) AS start_time,
    arg_max(ts, pos) AS end_time,
    max(score) AS max_score,
    arg_min(score, pos) AS first_score,
    arg_max(score, pos) AS last_score,
    CAST(max(best_pos) AS BIGINT) AS best_pos,
    CAST(max(gap) AS BIGINT) AS max_gap,
    avg(gap) AS mean_gap,
    {succ} AS success,
    CAST(floor((epoch_us(arg_max(ts, pos)) - epoch_us(arg_min(ts, pos))) / 1000000.0) AS BIGINT)
      AS time_to_solve
  FROM {src} GROUP BY {keys}"""


VIEWS = {
    "attempts": f"""SELECT user_id AS student_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS problem_id,
    event_type, event_id AS ord, ts,
    {_SCORE.format(e='least(floor(value), 100)')} AS score,
    event_id AS code_id
  FROM events""",
    "attempts_deep": f"""SELECT user_id AS student_id, event_type AS problem_id,
    event_id AS ord, ts,
    {_SCORE.format(e='least(floor(value), 100)')} AS score,
    event_id AS code_id
  FROM events""",
    "attempts_big": f"""SELECT o_custkey AS student_id, o_orderpriority AS course_id,
    l_partkey % 100 AS problem_id, o_orderdate AS ts,
    l_orderkey, l_linenumber, l_partkey, l_suppkey,
    {_SCORE.format(e='round(l_discount * 1000)')} AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "snapshots": "SELECT conv_id AS group_id, turn AS ord, role, text AS code FROM conversations",
    "code_states": """SELECT doc_id AS code_id, text AS code, source AS problem_id, lang, n_chars
  FROM documents""",
    "questions": f"""SELECT p_partkey % 100 AS id,
    arg_min(CASE WHEN p_type IN ('ECONOMY','LARGE') THEN 'skill'
                 WHEN p_type IN ('MEDIUM','PROMO') THEN 'lab' ELSE 'project' END, p_partkey) AS type,
    arg_min(p_name, p_partkey) AS prompt,
    {_flags_sql(FLAGS_B)}
  FROM part GROUP BY p_partkey % 100""",
    "questions_a": f"""SELECT p_partkey % 100 AS id,
    arg_min(CASE WHEN p_type IN ('ECONOMY','LARGE') THEN 'skill'
                 WHEN p_type IN ('MEDIUM','PROMO') THEN 'lab' ELSE 'project' END, p_partkey) AS type,
    arg_min(p_name, p_partkey) AS prompt,
    {_flags_sql(FLAGS_A)}
  FROM part GROUP BY p_partkey % 100""",
    "vectors": """SELECT vec_id AS id, CAST(label AS BIGINT) AS student_id,
    CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
    "predictions": """SELECT l.doc_id, d.source AS fold, d.lang AS dataset, CAST(l.quality AS DOUBLE) AS y_true,
    (d.n_chars % 1000) / 1000.0 AS y_prob
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    # sequenced rows and summaries
    "deep_seq0": _seq("attempts_deep", "student_id, problem_id", "ord"),
    "deep_rows": _bestpos("deep_seq0", "student_id, problem_id"),
    "deep_summary": _summary("deep_rows", "student_id, problem_id", "last"),
    "att_seq0": _seq("attempts", "student_id, problem_id", "ord"),
    "att_rows": _bestpos("att_seq0", "student_id, problem_id"),
    "att_summary": _summary("att_rows", "student_id, problem_id", "last"),
    "big_seq0": _seq("attempts_big", "student_id, course_id, problem_id",
                     "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey"),
    "big_rows": _bestpos("big_seq0", "student_id, course_id, problem_id"),
}

DEPS = {
    "deep_seq0": ["attempts_deep"], "deep_rows": ["deep_seq0"], "deep_summary": ["deep_rows"],
    "att_seq0": ["attempts"], "att_rows": ["att_seq0"], "att_summary": ["att_rows"],
    "big_seq0": ["attempts_big"], "big_rows": ["big_seq0"],
}


def _order(names):
    out = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    parts = [f"{n} AS (\n  {VIEWS[n]}\n)" for n in _order(names)]
    parts += [f"{n} AS (\n  {q}\n)" for n, q in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
