"""Classification metrics on a predictions table.

Input columns: ``y_true`` (0/1), ``y_prob`` and optional group columns
(``fold``, ``dataset``).  Everything is a grouped aggregate; ROC-type metrics
first collapse predictions to one row per (group, distinct score) with positive
and negative counts, so windows run over distinct scores, never over raw rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.prefix import prefix_sums
from attemptlog.session import cut_lineage


def predict(df: DataFrame, thr: float = 0.5, prob: str = "y_prob", out: str = "y_pred") -> DataFrame:
    """F19 (Q22): strict ``>`` against the threshold."""
    return df.withColumn(out, (F.col(prob) > F.lit(thr)).cast("int"))


def confusion_matrix(df: DataFrame, thr: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp per group."""
    p = F.col("y_prob") > F.lit(thr)
    y = F.col("y_true") == 1
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                 F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_metrics(df: DataFrame, thr: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0)."""
    cm = confusion_matrix(df, thr, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return cm.select(*by, (( tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
                     prec.alias("precision"), rec.alias("recall"),
                     _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positive / negative counts per (group, distinct score)."""
    return df.groupBy(*by, "y_prob").agg(
        F.sum(F.col("y_true")).cast("long").alias("pos"),
        F.sum(1 - F.col("y_true")).cast("long").alias("neg"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted one half (NULL for a single class).

    AUC = sum over scores s of pos(s) * (neg below s + neg(s) / 2) / (P * N).
    "neg below s" is a prefix sum over distinct scores, over ranges of equal row
    counts, so saturated or very many scores are spread like any others.
    """
    by = list(by)
    c = prefix_sums(score_counts(df, by), ["y_prob"], by, {"neg": "neg_below"})
    g = c.groupBy(*by) if by else c.groupBy()
    P, N = F.sum("pos"), F.sum("neg")
    num = F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg")))
    return g.agg(F.when((P == 0) | (N == 0), F.lit(None)).otherwise(num / (P * N)).alias("roc_auc"))


def roc_curve(df: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """(fpr, tpr, threshold) points, highest threshold first, starting at
    (0, 0, +inf).  With ``drop_intermediate`` collinear points are removed:
    among the distinct-score points the first, the last and every point where
    the second difference of fps or tps is non-zero are kept.

    Running counts are prefix sums over ranges, also for one group that holds
    everything; the second difference needs the next point's counts only."""
    by = list(by)
    c = score_counts(df, by).withColumn("_down", -F.col("y_prob"))
    c = prefix_sums(c, ["_down"], by, {"pos": "tps", "neg": "fps"}, rank="_rank",
                    following={"pos": "_npos", "neg": "_nneg"}) \
        .withColumn("tps", (F.col("tps") + F.col("pos")).cast("long")) \
        .withColumn("fps", (F.col("fps") + F.col("neg")).cast("long")).withColumn("idx", F.col("_rank") + 1)
    c = cut_lineage(c.drop("_down", "_rank"))
    tot = c.groupBy(*by) if by else c.groupBy()
    tot = tot.agg(F.max("tps").alias("P"), F.max("fps").alias("N"))
    if drop_intermediate:
        corner = (F.col("_nneg") != F.col("neg")) | (F.col("_npos") != F.col("pos"))
        c = c.filter((F.col("idx") == 1) | F.col("_npos").isNull() | corner)
    start = tot.filter("P is not null").select(
        *by, F.lit(float("inf")).alias("y_prob"), F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"),
        F.lit(0).cast("long").alias("idx"))
    pts = start.unionByName(c.select(*by, "y_prob", "tps", "fps", "idx"))
    pts = pts.join(tot, by, "inner") if by else pts.crossJoin(tot)
    return pts.select(*by, "idx", F.col("y_prob").alias("threshold"),
                      F.when(F.col("N") == 0, F.lit(None)).otherwise(F.col("fps") / F.col("N")).alias("fpr"),
                      F.when(F.col("P") == 0, F.lit(None)).otherwise(F.col("tps") / F.col("P")).alias("tpr"))


def youden_threshold(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr; ties go to the first point
    (highest threshold), as ``argmax`` over the curve does."""
    by = list(by)
    pts = roc_curve(df, by, drop_intermediate=False)
    pts = pts.withColumn("J", F.col("tpr") - F.col("fpr"))
    g = pts.groupBy(*by) if by else pts.groupBy()
    return g.agg(F.max_by("threshold", F.struct(F.col("J"), -F.col("idx"))).alias("threshold"),
                 F.max("J").alias("J"))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the probability."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg((F.col("y_prob") - F.col("y_true")) ** 2).alias("brier"))


def metrics_by_group(df: DataFrame, thr: float = 0.5, by: Sequence[str] = ("fold",)) -> DataFrame:
    """All metrics per group (one row per fold or dataset)."""
    by = list(by)
    m = classification_metrics(df, thr, by)
    return m.join(roc_auc(df, by), by, "inner").join(brier(df, by), by, "inner")


def average_over_groups(per_group: DataFrame) -> DataFrame:
    """Unweighted mean of per-fold metrics (NULL AUCs ignored)."""
    cols = [c for c in ("roc_auc", "accuracy", "precision", "recall", "f1", "brier")
            if c in per_group.columns]
    return per_group.agg(*[F.avg(c).alias(c) for c in cols])
