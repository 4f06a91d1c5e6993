"""Concept roll-up and concept lookups.

The concept map is driver-side metadata (a dict of a few dozen names); it is
turned into column expressions, never into a driver-side lookup of data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlog.sources.schema import CONCEPT_MAP, CONCEPTS


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def row_max(cols: Sequence[str]) -> Column:
    """row-wise max over flag columns, NULL read as 0; no column -> 0 (Q11)."""
    if not cols:
        return F.lit(0)
    parts = [F.coalesce(_q(c), F.lit(0)) for c in cols]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def rollup_concepts(questions: DataFrame, dataset: str = "falcon", keep: Sequence[str] = ("id",),
                    concept_map: dict | None = None, order: Sequence[str] = CONCEPTS,
                    out: str = "concepts") -> DataFrame:
    """K4: raw flags -> one 0/1 column per concept plus the vector."""
    cmap = (concept_map or CONCEPT_MAP)[dataset]
    exprs = [row_max(cmap.get(c, [])).cast("double").alias(c) for c in order]
    df = questions.select(*keep, *exprs)
    return df.withColumn(out, F.array(*[_q(c) for c in order]))


def attach_concepts(hist: DataFrame, concepts: DataFrame, row_key: Sequence[str],
                    ids: str = "prev_tasks_id", pad_to: int | None = 30, size: int = 10,
                    out: str = "prev_comp_cons", id_col: str = "id") -> DataFrame:
    """J10 + F11: array of task ids -> array of concept vectors, padded with
    zero vectors to ``pad_to``.

    Exploded with positions, joined to the question catalogue and re-collected
    by position (at most one history per row, so the collect is bounded by the
    history length).  An unknown id maps to a zero vector.
    """
    row_key = list(row_key)
    ex = hist.select(*row_key, F.posexplode(ids).alias("_k", "_tid"))
    cat = concepts.select(F.col(id_col).cast("string").alias("_tid"), F.col("concepts").alias("_v"))
    j = ex.join(cat, "_tid", "left")
    zero = F.array_repeat(F.lit(0.0), size)
    back = j.groupBy(*row_key).agg(
        F.sort_array(F.collect_list(F.struct("_k", F.coalesce("_v", zero).alias("_v")))).alias("_c"))
    vecs = F.transform("_c", lambda x: x["_v"])
    if pad_to:
        vecs = F.concat(vecs, F.array_repeat(zero, F.greatest(F.lit(pad_to) - F.size(vecs), F.lit(0))))
    back = back.select(*row_key, vecs.alias(out))
    return hist.join(back, row_key, "left")


def target_concepts(df: DataFrame, concepts: DataFrame, target: str = "new_task_id",
                    out: str = "curr_comp_cons", id_col: str = "id") -> DataFrame:
    """Concept vector of the target task (a plain lookup join)."""
    cat = concepts.select(F.col(id_col).cast("string").alias("_tid"), F.col("concepts").alias(out))
    return df.join(cat, df[target].cast("string") == cat["_tid"], "left").drop("_tid")
