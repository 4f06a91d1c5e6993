"""Per-person histories and the two preparation plans (A4-A6, W1-W2, W12-W13,
J3-J7, K1-K3).

Shape of the work:

* attempts are summarised per task on flat rows (skew-safe ``sequenced``);
* task-level windows (task number per student and course) run over *tasks*,
  whose count per student is bounded by the problem catalogue, not by the
  number of attempts;
* nesting happens last: one ``collect_list(struct)`` per student over at most
  ``n_hist`` tasks, sorted, then projected to the output contract.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlog.functions.textfn import clean_prompt
from attemptlog.functions.timefn import normalise_zone
from attemptlog.operators.attempts import attempt_rows, invert_labels, trim_after_best
from attemptlog.session import cut_lineage


# ---------------------------------------------------------------------------
# building blocks
# ---------------------------------------------------------------------------


def task_table(attempts: DataFrame, keys: Sequence[str], order: Sequence[str],
               trim: str = "all", perfect: float = 100.0, code: str | None = "code_id",
               ts: str = "ts", score: str = "score", lists: bool = True,
               sentinel: float | None = None) -> DataFrame:
    """One row per task with the ordered attempt array and its statistics.

    ``trim='all'`` (dataset B) cuts scores, snapshots and times at the first
    maximum; ``'code_if_perfect'`` (dataset A) cuts only the snapshots and only
    when the maximum is perfect (Q6).  A task without any score keeps all its
    attempts and a NULL maximum.  With ``sentinel``, ``n_sentinel`` counts it.
    """
    keys = list(keys)
    carry = [code] if code else []
    rows = attempt_rows(attempts, keys, order, ts=ts, score=score, carry=carry)
    rows = rows.withColumn("perfect", F.lit(float(perfect)))
    if trim == "all":
        rows = trim_after_best(rows, "all").withColumn("code_kept", F.lit(True))
    elif trim == "code_if_perfect":
        rows = trim_after_best(rows, "code_if_perfect")
    else:
        rows = rows.withColumn("code_kept", F.lit(True))
    stats = [F.min_by(F.col(ts), F.col("pos")).alias("start_time"),
             F.max_by(F.col(ts), F.col("pos")).alias("end_time"),
             F.max(score).alias("max_score"),
             F.count(F.lit(1)).cast("long").alias("num_snapshots")]
    if sentinel is not None:
        stats.append(F.count_if(F.col(score) == F.lit(float(sentinel))).alias("n_sentinel"))
    if not lists:
        # statistics only: plain partial aggregates, no per-task arrays
        return rows.groupBy(*keys).agg(*stats)
    fields = [F.col("pos"), F.col(ts).alias("ts"), F.col(score).alias("score"),
              F.col("code_kept")]
    if code:
        fields.append(F.col(code).alias("code"))
    t = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("attempts"), *stats)
    t = t.withColumn("scores", F.transform("attempts", lambda a: a["score"])) \
         .withColumn("times", F.transform("attempts", lambda a: a["ts"]))
    if code:
        t = t.withColumn("codes", F.transform(F.filter("attempts", lambda a: a["code_kept"]),
                                              lambda a: a["code"]))
    return t.drop("attempts")


def valid_students(tasks: DataFrame, group: Sequence[str] = ("student_id", "course_id"),
                   task_order: Sequence[str] = ("problem_id",), n: int = 31,
                   max_bad: int = 30, sentinel: float = -1.0,
                   student: str = "student_id") -> DataFrame:
    """A5 (Q9): students with at least one (student, course) group whose first
    ``n`` tasks (in problem-id order) hold at most ``max_bad`` sentinel scores.

    Tasks per group are bounded by the problem catalogue, so the window is over
    a small group.  Tasks carry the sentinel count ``n_sentinel`` (a statistic of
    :func:`task_table`) or, failing that, the ``scores`` array.
    """
    w = Window.partitionBy(*group).orderBy(*task_order)
    bad = F.col("n_sentinel") if "n_sentinel" in tasks.columns else \
        F.size(F.filter("scores", lambda s: s == F.lit(sentinel)))
    t = tasks.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    per = t.groupBy(*group).agg(F.sum(bad).alias("_bad"))
    return per.filter(F.col("_bad") <= max_bad).select(student).distinct()


def problem_percentile(tasks: DataFrame, q: float = 0.75, problem: str = "problem_id",
                       col: str = "num_snapshots", out: str = "p75") -> DataFrame:
    """Exact linearly interpolated percentile per problem.

    ``percentile`` keeps a count per distinct value and merges partial
    buffers, so a hot problem is combined map-side.
    """
    return tasks.groupBy(problem).agg(F.percentile(F.col(col), F.lit(q)).alias(out))


def label_struggle(tasks: DataFrame, questions: DataFrame | None = None, q: float = 0.75,
                   perfect: float = 100.0, problem: str = "problem_id",
                   drop_types: Sequence[str] = ("project",)) -> DataFrame:
    """K3 (Q8): Label = solved and attempts <= the problem's P75.

    The percentile is computed across courses and *before* projects are
    removed; ``tasks`` must carry ``type`` if ``drop_types`` is used.
    """
    p = problem_percentile(tasks, q, problem)
    j = tasks.join(p, problem, "inner")
    if drop_types and "type" in j.columns:
        j = j.filter(~F.col("type").isin(list(drop_types)))
    return (j.withColumn("below_p75", F.col("num_snapshots") <= F.col("p75"))
             .withColumn("correct_eventually", F.coalesce(F.col("max_score") >= perfect, F.lit(False)))
             .withColumn("Label", F.col("below_p75") & F.col("correct_eventually")))


def number_tasks(tasks: DataFrame, group: Sequence[str] = ("student_id", "course_id"),
                 order: Sequence[str] = ("end_time", "problem_id"), out: str = "row_number") -> DataFrame:
    """Task number per (student, course) by end time (ties by problem id)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return tasks.withColumn(out, F.row_number().over(w))


def early_late(numbered: DataFrame, n_hist: int = 30, n_last: int = 50,
               col: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """History tasks (<= n_hist) and target tasks (n_hist < k <= n_last)."""
    early = numbered.filter(F.col(col) <= n_hist)
    late = numbered.filter((F.col(col) > n_hist) & (F.col(col) <= n_last))
    return early, late


def build_history(early: DataFrame, group: Sequence[str] = ("student_id", "course_id"),
                  order: str = "row_number", code: bool = True,
                  times: bool = False) -> DataFrame:
    """A4: per-person history lists, ordered, plus ``num_tasks``.

    One ``collect_list(struct)`` per group, sorted by the task order; the
    group holds at most ``n_hist`` tasks (bounded by W2).
    """
    fields = [F.col(order).alias("k"), F.col("problem_id").cast("string").alias("task_id"),
              F.col("scores"), F.col("Label").alias("label")]
    if code:
        fields.append(F.col("codes"))
    if times:
        fields.append(F.col("times"))
    h = early.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_h"))
    h = h.select(*group,
                 F.transform("_h", lambda x: x["task_id"]).alias("prev_tasks_id"),
                 F.transform("_h", lambda x: x["scores"]).alias("prev_scores"),
                 F.transform("_h", lambda x: x["label"]).alias("prev_labels"),
                 F.size("_h").cast("long").alias("num_tasks"),
                 *([F.transform("_h", lambda x: x["codes"]).alias("prev_tasks")] if code else []),
                 *([F.transform("_h", lambda x: x["times"]).alias("all_times")] if times else []))
    return h


def attach_history(late: DataFrame, history: DataFrame,
                   group: Sequence[str] = ("student_id", "course_id")) -> DataFrame:
    """Left join target tasks to the person's history."""
    return late.join(history, list(group), "left")


def history_long(attempt_rows: DataFrame, numbered: DataFrame,
                 group: Sequence[str] = ("student_id", "course_id"), n_hist: int = 30,
                 task_key: str = "problem_id") -> DataFrame:
    """A4 in long form: one row per (person, history task number, attempt
    position), exact and without arrays.

    The nested contract puts every attempt of a task into one array; a task
    with very many attempts then becomes one huge value.  This form carries the
    same content as flat rows (join of the sequenced attempts with the task
    numbers), so nothing is collected per task."""
    group = list(group)
    t = numbered.filter(F.col("row_number") <= n_hist) \
                .select(*group, task_key, F.col("row_number").alias("task_number"), "Label")
    return attempt_rows.join(t, group + [task_key], "inner")


def last_snapshots(df: DataFrame, n: int = 100, col: str = "prev_tasks") -> DataFrame:
    """Keep the last ``n`` snapshots of every history task."""
    return df.withColumn(col, F.transform(
        col, lambda c: F.slice(c, F.greatest(F.size(c) - n, F.lit(0)) + 1, n)))


def truncate_history(df: DataFrame, n: int = 30,
                     cols: Sequence[str] = ("prev_tasks", "prev_scores", "prev_labels",
                                            "prev_tasks_id")) -> DataFrame:
    """First ``n`` history tasks."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.slice(c, 1, n))
    return df


# ---------------------------------------------------------------------------
# K2: dataset B preparation
# ---------------------------------------------------------------------------


def submission_stages(subs: DataFrame, questions: DataFrame, n_hist: int = 30,
                      n_last: int = 50, order: Sequence[str] = ("ts",),
                      keys: Sequence[str] = ("student_id", "course_id", "problem_id"),
                      q: float = 0.75, perfect: float = 100.0, sentinel: float = -1.0,
                      valid_n: int = 31, valid_max_bad: int = 30,
                      question_keys: Sequence[str] = ("problem_id",),
                      code: str | None = "code_id") -> dict:
    """The stages of K2, each a DataFrame: ``tasks`` (valid, labelled task
    table), ``numbered`` (with the task number), ``history`` (per student and
    course) and ``final`` (the output contract).

    The task table and the numbered table feed several branches (validity,
    percentile, history/targets); both are checkpointed into the shared
    checkpoint folder so the branches read a materialised table instead of
    re-running the attempt plan, and a lost executor never forces a recompute
    of the whole chain.
    """
    keys = list(keys)
    group = [k for k in keys if k != "problem_id"]
    tasks = cut_lineage(task_table(subs, keys, list(order), trim="all", perfect=perfect, code=code,
                                   sentinel=sentinel))
    ok = valid_students(tasks, group=group, n=valid_n, max_bad=valid_max_bad,
                        sentinel=sentinel)
    tasks = tasks.join(ok, "student_id", "left_semi") \
                 .filter(F.col("n_sentinel") == 0)
    qs = questions.withColumn("prompt", clean_prompt(F.col("prompt")))
    qkeys = list(question_keys)
    cond = [tasks[qk] == qs["id" if qk == "problem_id" else qk] for qk in qkeys]
    qsel = qs.select(*[F.col(c) for c in qs.columns if c not in qkeys or c == "id"])
    tasks = tasks.join(qsel, cond[0] if len(cond) == 1 else cond, "inner").drop("id")
    labelled = label_struggle(tasks, q=q, perfect=perfect)
    numbered = cut_lineage(number_tasks(labelled, group=group, order=("end_time", "problem_id")))
    early, late = early_late(numbered, n_hist, n_last)
    hist = build_history(early, group=group, code=code is not None)
    out = attach_history(late, hist, group).filter(F.col("num_tasks") == n_hist)
    out = out.withColumnRenamed("problem_id", "new_task_id") \
             .withColumnRenamed("prompt", "new_task")
    out = invert_labels(out)
    cols = group + ["new_task_id", "max_score", "new_task", "prev_tasks_id",
                    *(["prev_tasks"] if code else []), "prev_scores", "prev_labels", "Label"]
    final = out.select(*cols, F.col("row_number").alias("task_number"))
    return {"tasks": labelled, "numbered": numbered, "history": hist, "final": final}


def prepare_submissions(subs: DataFrame, questions: DataFrame, n_hist: int = 30,
                        n_last: int = 50, order: Sequence[str] = ("ts",),
                        keys: Sequence[str] = ("student_id", "course_id", "problem_id"),
                        q: float = 0.75, perfect: float = 100.0, sentinel: float = -1.0,
                        valid_n: int = 31, valid_max_bad: int = 30,
                        question_keys: Sequence[str] = ("problem_id",),
                        code: str | None = "code_id") -> DataFrame:
    """K2: submissions -> one row per (student, course, target task).

    F2 -> A1 -> W3 -> A5 -> P8 -> J4 -> K3 -> W1 -> W2 -> A4 -> J6 -> P11.
    ``questions`` has ``id``, ``type``, ``prompt``; ``question_keys`` are the
    attempt columns matched to ``id`` (add ``course_id`` for a two-key match).
    """
    return submission_stages(subs, questions, n_hist, n_last, order, keys, q, perfect,
                             sentinel, valid_n, valid_max_bad, question_keys, code)["final"]


# ---------------------------------------------------------------------------
# K1: dataset A preparation
# ---------------------------------------------------------------------------


def prepare_event_log(events: DataFrame, code: DataFrame, early: DataFrame, late: DataFrame,
                      questions: DataFrame, event_type: str | None = "Run.Program",
                      keys: Sequence[str] = ("student_id", "assignment_id", "problem_id"),
                      order: Sequence[str] = ("ord",), perfect: float = 100.0,
                      zone: str | None = "zone") -> DataFrame:
    """K1: event log -> one row per (student, target task) with the history.

    P1 -> P2 -> J1 -> F4 -> J2 -> A1 -> W3 (code only, if perfect) -> J3 ->
    J5 -> A4 -> J6 -> P5.  ``early``/``late`` are label tables keyed like the
    tasks with a boolean ``Label``; ``code`` has ``code_id``, ``code``.
    """
    keys = list(keys)
    ev = events
    if event_type is not None:
        ev = ev.filter(F.col("event_type") == event_type)
    code = code.na.drop(subset=["code"])
    ev = ev.na.drop(subset=keys + ["code_id"])      # an attempt without an order or time stays
    # J1 (semi join on code) followed by J2 (left join of the code text) is one
    # inner join: a single shuffle of the event log instead of two.
    ev = ev.join(code, "code_id", "inner")                                 # J1 + J2
    if zone and zone in ev.columns:
        ev = ev.withColumn("ts", normalise_zone("ts", zone))               # F4
    tasks = cut_lineage(task_table(ev, keys, list(order), trim="code_if_perfect",
                                   perfect=perfect, code="code"))
    q = questions.withColumnRenamed("id", "problem_id")
    qkeys = [k for k in keys if k in q.columns and k != "student_id"]
    tasks = tasks.join(q.select(*qkeys, "prompt"), qkeys, "inner")         # J3
    tkeys = [k for k in keys]
    late_t = late.join(tasks, tkeys, "left")                               # J5
    early_t = early.join(tasks, tkeys, "left")
    early_t = early_t.withColumn("row_number", F.row_number().over(
        Window.partitionBy("student_id").orderBy(F.col("end_time").asc_nulls_last(),
                                                 *[F.col(k) for k in tkeys[1:]])))
    hist = build_history(early_t, group=["student_id"], code=True, times=True)
    out = attach_history(late_t, hist, ["student_id"])                   # J6
    out = out.withColumnRenamed("problem_id", "new_task_id").withColumnRenamed("prompt", "new_task")
    out = invert_labels(out)
    rest = [k for k in keys if k not in ("student_id", "problem_id")]
    return out.select("student_id", *rest, "new_task_id", "max_score", "new_task",
                      "prev_tasks_id", "prev_tasks", "prev_scores", "prev_labels",
                      "all_times", "Label")
