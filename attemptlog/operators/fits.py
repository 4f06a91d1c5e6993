"""Logistic regressions of all folds and penalties at once.

One pass over the rows a step gives the losses, gradients and curvatures of every model
that has not converged yet; the driver sees sums of fixed size alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlog.operators.metrics import average_over_groups, roc_auc
from attemptlog.session import cut_lineage


def _prepared(df: DataFrame, features: Sequence[str], label: str, fold: str) -> DataFrame:
    """(fold, y, x): rows with a fold and a label; x with null for missing and NaN features."""
    x = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features])
    return df.select(F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), x.alias("x")) \
        .filter(F.col("fold").isNotNull() & F.col("y").isNotNull())


def _moments(data: DataFrame, d: int) -> tuple[list, np.ndarray]:
    """The folds in order and, for each fold and feature, count, mean and population variance."""
    aggs = [f(F.col("x")[j]).alias(f"{name}{j}") for j in range(d)
            for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    rows = sorted(data.groupBy("fold").agg(*aggs).collect(), key=lambda r: r["fold"])
    table = [[[r[f"{k}{j}"] or 0.0 for k in "nmv"] for j in range(d)] for r in rows]
    return [r["fold"] for r in rows], np.array(table, float).reshape(len(rows), d, 3)


def _merged(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of each feature over several folds; 1 for a constant."""
    n, m, v = parts[..., 0], parts[..., 1], parts[..., 2]
    total = n.sum(0)
    mean = (n * m).sum(0) / np.maximum(total, 1)
    spread = (n * (v + (m - mean) ** 2)).sum(0) / np.maximum(total - 1, 1)
    return mean, np.where(spread > 0, np.sqrt(spread), 1.0)


def _step(data: DataFrame, d: int, mean: np.ndarray, dev: np.ndarray, weights: np.ndarray, held: list) -> np.ndarray:
    """For each model, over the rows outside its held-out fold: rows, log loss, gradient and
    curvature at ``weights`` (models x (1 + features), on features scaled by ``mean`` and ``dev``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(held), 2 + (d + 1) + (d + 1) ** 2))
        for b in batches:
            if not len(b):
                continue
            x = np.array([[np.nan if v is None else v for v in row] for row in b["x"]], float).reshape(len(b), d)
            z = np.hstack([np.ones((len(b), 1)), np.nan_to_num((x - mean) / dev, nan=0.0)])
            y, fold = b["y"].to_numpy(), b["fold"].to_numpy()
            for k, f in enumerate(held):
                at = fold != f
                zk, yk = z[at], y[at]
                margin = zk @ weights[k]
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss = (np.logaddexp(0, margin) - yk * margin).sum()
                curve = (zk * (p * (1 - p))[:, None]).T @ zk
                total[k] += np.concatenate([[at.sum(), loss], zk.T @ (p - yk), curve.ravel()])
        yield pd.DataFrame({"model": range(len(held)), "sums": list(total)})
    sums = data.mapInPandas(run, "model long, sums array<double>").select("model", F.posexplode("sums").alias("pos", "v")) \
        .groupBy("model", "pos").agg(F.sum("v").alias("v")).collect()       # models x (features + 2) ** 2 numbers or fewer
    out = np.zeros((len(held), 2 + (d + 1) + (d + 1) ** 2))
    for r in sums:
        out[r["model"], r["pos"]] = r["v"]
    return out


def fit_models(df: DataFrame, features: Sequence[str], grid: Sequence[float] = (0.0,), label: str = "Label",
               fold: str = "fold", max_steps: int = 50, tol: float = 1e-8) -> DataFrame:
    """One logistic regression for every (fold, penalty), fitted on the rows of the other folds.

    Returns (fold, reg, intercept, coefficients, steps, converged).  The objective is the mean log loss
    plus ``reg / 2`` times the squared coefficients of the features scaled to deviation 1 over
    the model's rows; the intercept is free.  Newton steps, halved while the objective rises, until no entry of
    the gradient exceeds ``tol``; a model that has no optimum (separable without a penalty) ends at
    ``max_steps`` as not converged.  Rows without a label or fold are left out; a missing feature counts
    as its mean over all folds.  With one fold there is nothing to fit on and its model is zero.  No rows give no models.
    """
    d, spark = len(features), df.sparkSession
    data = cut_lineage(_prepared(df, features, label, fold))
    folds, parts = _moments(data, d)
    mean, dev = _merged(parts) if folds else (np.zeros(d), np.ones(d))
    models = [(f, float(r)) for f in folds for r in grid]
    # own penalty of a coefficient: on features scaled over the model's rows instead of all
    scale = np.array([dev / _merged(np.delete(parts, k, 0))[1] for k in range(len(folds)) for _ in grid]).reshape(len(models), d)
    penalty = np.hstack([np.zeros((len(models), 1)), np.array([r for _, r in models]).reshape(-1, 1) / scale ** 2])
    best = np.zeros((len(models), d + 1))
    move, low = np.zeros_like(best), np.full(len(models), np.inf)
    steps, done = np.zeros(len(models), int), np.zeros(len(models), bool)
    for _ in range(max_steps):
        left = np.flatnonzero(~done)
        if not len(left):
            break
        tried = best[left] + move[left]
        sums = _step(data, d, mean, dev, tried, [models[k][0] for k in left])
        for k, w, s in zip(left.tolist(), tried, sums, strict=True):
            steps[k] += 1
            if s[0] == 0:
                done[k] = True
                continue
            value = s[1] / s[0] + (penalty[k] * w * w).sum() / 2
            if value > low[k] + 1e-13 * max(1.0, abs(low[k])):
                move[k] /= 2
                continue
            gradient = s[2:d + 3] / s[0] + penalty[k] * w
            best[k], low[k] = w, value
            done[k] = np.abs(gradient).max() <= tol
            move[k] = -np.linalg.pinv(s[d + 3:].reshape(d + 1, d + 1) / s[0] + np.diag(penalty[k])) @ gradient
    raw = best[:, 1:] / dev
    bias = best[:, 0] - raw @ mean
    rows = [(f, r, float(bias[k]), raw[k].tolist(), int(steps[k]), bool(done[k])) for k, (f, r) in enumerate(models)]
    kind = data.schema["fold"].dataType.simpleString()
    return spark.createDataFrame(rows, f"fold {kind}, reg double, intercept double, coefficients array<double>, "
                                       "steps int, converged boolean") \
        .withColumn("means", F.array(*[F.lit(float(m)) for m in mean])).withColumnRenamed("fold", fold)


def score_held_out(df: DataFrame, models: DataFrame, features: Sequence[str], label: str = "Label",
                   fold: str = "fold") -> DataFrame:
    """(fold, reg, y_true, y_prob): every row scored by the models of its own fold, which have not
    seen it.  The models, one row a (fold, penalty), are broadcast."""
    x = F.transform("x", lambda v, j: F.coalesce(v, F.col("means")[j]))
    margin = F.aggregate(F.zip_with(x, "coefficients", lambda a, b: a * b), F.col("intercept"), lambda a, v: a + v)
    return _prepared(df, features, label, fold).join(F.broadcast(models.withColumnRenamed(fold, "fold")), "fold") \
        .select(F.col("fold").alias(fold), "reg", F.col("y").alias("y_true"), (1 / (1 + F.exp(-margin))).alias("y_prob"))


def tune_models(df: DataFrame, features: Sequence[str], grid: Sequence[float] = (0.0, 0.01, 0.1), label: str = "Label",
                fold: str = "fold") -> DataFrame:
    """1 - mean held-out AUC of each penalty; all fits share their passes over the rows."""
    data = cut_lineage(df.select(*features, label, fold))
    scored = score_held_out(data, fit_models(data, features, grid, label, fold), features, label, fold)
    auc = roc_auc(scored, ["reg", fold])
    return auc.groupBy("reg").agg((1 - F.avg("roc_auc")).alias("objective"))
