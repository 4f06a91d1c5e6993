"""Lookup joins between attempts, code states and questions.

Join strategy is left to Catalyst/AQE: a lookup side whose estimated size is
under ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything larger
is shuffled.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.attempts import first_per_key


def with_code_only(attempts: DataFrame, code: DataFrame, key: str = "code_id") -> DataFrame:
    """Attempts whose code state exists (left semi join)."""
    return attempts.join(code.select(key), key, "left_semi")


def attach_code(attempts: DataFrame, code: DataFrame, key: str = "code_id",
                how: str = "left") -> DataFrame:
    """Attach the code text (left or inner)."""
    return attempts.join(code.select(key, "code"), key, how)


def attach_questions(df: DataFrame, questions: DataFrame, left_keys: Sequence[str],
                     right_keys: Sequence[str], suffix: str = "_q") -> DataFrame:
    """Inner join on one or two keys that may have different names;
    colliding non-key columns of the question side get ``suffix``."""
    left_keys, right_keys = list(left_keys), list(right_keys)
    ren = {c: c + suffix for c in questions.columns if c in df.columns and c not in right_keys}
    ren.update({rk: f"__k{i}" for i, rk in enumerate(right_keys)})
    q = questions.withColumnsRenamed(ren)
    cond = [df[lk] == q[f"__k{i}"] for i, lk in enumerate(left_keys)]
    return df.join(q, cond, "inner").drop(*[f"__k{i}" for i in range(len(right_keys))])


def unknown_questions(attempts: DataFrame, questions: DataFrame, key: str = "problem_id",
                      q_key: str = "id") -> DataFrame:
    """Attempts whose question is not in the question table (left anti)."""
    q = questions.select(F.col(q_key).alias(key)).distinct()
    return attempts.join(q, key, "left_anti")


def attach_snapshots(df: DataFrame, code: DataFrame, row_key: Sequence[str], ids: str,
                     key: str = "code_id", text: str = "code", out: str = "snapshots",
                     order: Sequence[str] | None = None) -> DataFrame:
    """Array of code-state ids -> array of code texts, by position.

    The code table is first reduced to one row per id (first match by
    ``order``, default the text itself), then joined on the exploded ids and
    re-collected by position; unknown ids keep their slot as NULL.
    """
    row_key = list(row_key)
    first = first_per_key(code.select(key, text), [key], list(order or [text]))
    ex = df.select(*row_key, F.posexplode(ids).alias("_pos", key))
    j = ex.join(first, key, "left")
    back = j.groupBy(*row_key).agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.col(text).alias("_t")))).alias("_s"))
    return df.join(back.select(*row_key, F.transform("_s", lambda x: x["_t"]).alias(out)),
                   row_key, "left")


def attach_embeddings(df: DataFrame, emb: DataFrame, row_key: Sequence[str],
                      codes: str = "prev_tasks", out: str = "prev_vecs") -> DataFrame:
    """Nested code texts -> nested embedding vectors.

    Joined on ``md5(code)`` *and* the code itself (the hash keeps the shuffle
    key small, the equality keeps it exact)."""
    row_key = list(row_key)
    e = emb.select(F.md5("code").alias("_h"), F.col("code").alias("_c"), F.col("vector").alias("_v"))
    ex = df.select(*row_key, F.posexplode(codes).alias("_t", "_codes")) \
           .select(*row_key, "_t", F.posexplode("_codes").alias("_s", "_c"))
    ex = ex.withColumn("_h", F.md5("_c"))
    j = ex.join(e, ["_h", "_c"], "left")
    per_task = j.groupBy(*row_key, "_t").agg(
        F.sort_array(F.collect_list(F.struct("_s", "_v"))).alias("_x"))
    per_task = per_task.select(*row_key, "_t", F.transform("_x", lambda x: x["_v"]).alias("_vs"))
    back = per_task.groupBy(*row_key).agg(F.sort_array(F.collect_list(F.struct("_t", "_vs"))).alias("_y"))
    return df.join(back.select(*row_key, F.transform("_y", lambda x: x["_vs"]).alias(out)),
                   row_key, "left")
