"""Missing constructs in the final snapshot.

The regexes run JVM-side through ``rlike`` (one per construct, only for the
constructs the question requires: the ``AND`` short-circuits), so no Python
touches the text.  Whole texts are searched; nothing is truncated.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlog.functions.catalogues import FLAGS_PREFIX


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def detect(text, catalogue: dict, prefix: str = FLAGS_PREFIX) -> Column:
    """F8: names of the constructs whose pattern occurs in the text."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.array(*[F.when(text.rlike(prefix + p), F.lit(n)) for n, p in catalogue.items()])
    return F.filter(found, lambda x: x.isNotNull())


def merge_flags(questions: DataFrame, merges: dict, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Question flags for a merged catalogue: each new flag is the max of raw ones."""
    cols = []
    for new, raw in merges.items():
        if not raw:
            e = F.lit(0)
        elif len(raw) == 1:
            e = F.coalesce(_q(raw[0]), F.lit(0))
        else:
            e = F.greatest(*[F.coalesce(_q(r), F.lit(0)) for r in raw])
        cols.append(e.cast("int").alias(new))
    return questions.select(*keep, *cols)


def missing_array(text, flags: Sequence[str], catalogue: dict, prefix: str = FLAGS_PREFIX) -> Column:
    """Required (flag = 1) minus found.  A required flag without a pattern
    in the catalogue is always missing (the literal behaviour, Q36)."""
    text = F.col(text) if isinstance(text, str) else text
    parts = []
    for f in flags:
        req = F.coalesce(_q(f), F.lit(0)) == 1
        if f in catalogue:
            cond = req & ~F.coalesce(text.rlike(prefix + catalogue[f]), F.lit(False))
        else:
            cond = req
        parts.append(F.when(cond, F.lit(f)))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def missing_constructs(tasks: DataFrame, questions: DataFrame, catalogue: dict,
                       flags: Sequence[str], text: str = "final_text",
                       task_key: str = "problem_id", q_key: str = "id",
                       keep_all: bool = False) -> DataFrame:
    """K8: per task, the required constructs absent from the final snapshot.

    Tasks whose question is unknown are skipped (inner join).  Only tasks with
    at least one missing construct are returned unless ``keep_all``.
    """
    q = questions.select(F.col(q_key).alias("_qid"), *[_q(f) for f in flags])
    j = tasks.join(q, tasks[task_key] == F.col("_qid"), "inner").drop("_qid")
    j = j.withColumn("missing", missing_array(text, flags, catalogue)).drop(*flags)
    return j if keep_all else j.filter(F.size("missing") > 0)


def missing_construct_share(missing: DataFrame, by: str = "success",
                            denominators: DataFrame | None = None) -> DataFrame:
    """Count per (outcome, construct) and its share -- over the sum of the
    counts of that outcome, or over a given count per outcome (``denominators``
    with columns ``by`` and ``n``)."""
    ex = missing.select(by, F.explode("missing").alias("construct"))
    c = ex.groupBy(by, "construct").agg(F.count(F.lit(1)).alias("count"))
    if denominators is None:
        tot = c.groupBy(by).agg(F.sum("count").alias("_n"))
    else:
        tot = denominators.select(by, F.col("n").alias("_n"))
    return c.join(tot, by, "inner").withColumn("share", F.col("count") / F.col("_n")).drop("_n")


def missing_rate(all_tasks: DataFrame, by: str = "success") -> DataFrame:
    """Share of tasks with at least one missing construct, per outcome."""
    return all_tasks.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(F.size("missing") > 0).alias("n_missing"),
        F.avg((F.size("missing") > 0).cast("double")).alias("missing_rate"))
