"""Rubric scoring inputs and answer post-processing.

Answers are regrouped by explicit (student, position) keys, never by blind
chunks of a fixed size (Q16).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.functions.textfn import ascii_lower, clean_prompt, first_brace_block

# Rubric key spellings accepted in a model's JSON answer
# (tolerant parser: lower-cased, non-ASCII removed), first spelling wins
# unless its value is 0 or missing.
RUBRIC_KEYS = {
    "decomposition": ["decomposition"],
    "alg": ["algorithmic_design", "algorithmic design"],
    "reading": ["reading comprehension", "reading_comprehension"],
}


def build_rubric_inputs(hist: DataFrame, questions: DataFrame, which: str = "last",
                        row_key: Sequence[str] = ("student_id", "course_id"),
                        ids: str = "prev_tasks_id", codes: str = "prev_tasks",
                        q_keys: Sequence[str] = ("id",), hist_q_keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """J17 + F23: one prompt per (student, history position): the question
    text followed by the first or last snapshot of that task."""
    row_key = list(row_key)
    ex = hist.select(*row_key, F.posexplode(F.arrays_zip(F.col(ids).alias("task_id"),
                                                         F.col(codes).alias("codes"))).alias("position", "t"))
    ex = ex.select(*row_key, "position", F.col("t.task_id").alias("task_id"), F.col("t.codes").alias("codes"))
    q = questions.select(*[F.col(c).cast("string").alias(f"_q{i}") for i, c in enumerate(q_keys)],
                         clean_prompt(F.col("prompt")).alias("question"))
    cond = [ex[h] == q[f"_q{i}"] for i, h in enumerate(hist_q_keys)]
    j = ex.join(q, cond, "inner")
    snap = F.element_at("codes", 1 if which == "first" else -1)
    prompt = F.concat_ws("\n", F.lit("Task:"), F.col("question"), F.lit("Student code:"),
                         F.coalesce(snap.cast("string"), F.lit("")))
    return j.select(*row_key, "position", "task_id", prompt.alias("prompt"))


def parse_rubric(answers: DataFrame, answer: str = "answer", keys: dict | None = None,
                 tolerant: bool = True) -> DataFrame:
    """K21 (per answer): add ``parsed`` (JSON found and parsed) and one score
    column per rubric skill."""
    keys = keys or RUBRIC_KEYS
    a = F.col(answer)
    if tolerant:
        a = ascii_lower(a)
    block = first_brace_block(a)
    df = answers.withColumn("__m", F.from_json(F.when(block != "", block), "map<string,string>"))
    for name, spellings in keys.items():
        vals = [F.expr(f"try_cast(element_at(`__m`, '{s}') AS DOUBLE)") for s in spellings]
        e = vals[-1]
        for v in reversed(vals[:-1]):
            e = F.coalesce(F.nullif(v, F.lit(0.0)), e)
        df = df.withColumn(name, e)
    return df.withColumn("parsed", F.col("__m").isNotNull()).drop("__m")


def collect_rubric(parsed: DataFrame, keys: Sequence[str] = ("student_id", "course_id"), position: str = "position",
                   names: Sequence[str] = ("decomposition", "alg", "reading")) -> DataFrame:
    """K21 (per student and course): ordered score arrays keyed by position, Q16.

    One struct per answer is collected so NULL scores keep their slot (Q2)."""
    st = F.struct(F.col(position).alias("p"), *[F.col(n).alias(n) for n in names])
    g = parsed.groupBy(*keys).agg(F.sort_array(F.collect_list(st)).alias("_s"))
    return g.select(*keys, *[F.transform("_s", _field(n)).alias(n) for n in names])


def _field(name: str):
    return lambda x: x[name]


def rubric_retries(parsed: DataFrame, attempt: str = "attempt", max_retries: int = 3) -> DataFrame:
    """Answers that need another generation: no parseable JSON and fewer
    than ``max_retries`` retries so far."""
    a = F.col(attempt) if attempt in parsed.columns else F.lit(0)
    return parsed.filter(~F.col("parsed") & (a < max_retries))
