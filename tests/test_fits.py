"""All folds and penalties in one pass, against plain numpy and single fits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attemptlog.operators import fits as FT
from attemptlog.operators.jobs import fit_struggle

SCHEMA = "a double, b double, c double, Label int, fold int"


def rows(n=600, seed=3):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        a, b = rnd.gauss(5e4, 900), rnd.expovariate(0.2)
        y = int(rnd.random() < 1 / (1 + np.exp(-((a - 5e4) / 600 + b / 6 - 1))))
        out.append((a, b, 7.0, y, k % 4))
    return out


def plain(rows, fold, reg, steps=20000):
    """Gradient descent on scaled features: the objective as the docstring states it."""
    data = np.array([r for r in rows if r[4] != fold], float)
    x, y = data[:, :3], data[:, 3]
    mean, dev = x.mean(0), x.std(0, ddof=1)
    dev[dev == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / dev])
    w, pen = np.zeros(4), np.array([0, reg, reg, reg])
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-(z @ w))) - y) / len(y) + pen * w
        w -= g
    coef = w[1:] / dev
    return w[0] - coef @ mean, coef


@pytest.mark.parametrize("reg", [0.0, 0.3])
def test_models_reach_the_optimum(spark, reg):
    data = rows()
    got = {r["fold"]: r for r in FT.fit_models(spark.createDataFrame(data, SCHEMA).repartition(5), "abc", (reg, 1.0)).collect()
           if r["reg"] == reg}
    assert sorted(got) == [0, 1, 2, 3] and all(r["converged"] for r in got.values())
    for f in (0, 3):
        bias, coef = plain(data, f, reg)
        assert np.allclose(got[f]["coefficients"], coef, rtol=1e-5, atol=1e-9)
        assert abs(got[f]["intercept"] - bias) < 1e-4 * abs(bias)


def test_scores_equal_those_of_single_fits(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    models = FT.fit_models(df, ["a", "b"], (0.0, 0.1))
    scored = FT.score_held_out(df, models, ["a", "b"])
    for reg in (0.0, 0.1):
        one = fit_struggle(df, ["a", "b"], reg=reg, max_iter=200)
        key = ["fold", "y_true", "y_prob"]
        x = sorted(map(tuple, scored.filter(F.col("reg") == reg).select(key).collect()))
        y = sorted(map(tuple, one.select(key).collect()))
        assert len(x) == 600 and np.allclose(np.array(x, float), np.array(y, float), atol=2e-4)


def test_penalties_are_ranked(spark):
    got = {r["reg"]: r["objective"] for r in FT.tune_models(spark.createDataFrame(rows(), SCHEMA), ["a", "b"], (0.0, 0.1)).collect()}
    assert set(got) == {0.0, 0.1} and all(0 < v < 0.4 for v in got.values())


def test_odd_rows(spark):
    data = rows(80) + [(None, 1.0, 7.0, 1, 0), (float("nan"), 2.0, 7.0, 0, 1), (1.0, 1.0, 1.0, None, 0), (1.0, 1.0, 1.0, 1, None)]
    df = spark.createDataFrame(data, SCHEMA)
    models = FT.fit_models(df, ["a", "b"], (0.1,))
    assert models.count() == 4 and models.filter("converged").count() == 4
    assert FT.score_held_out(df, models, ["a", "b"]).filter("y_prob between 0 and 1").count() == 82
    assert FT.fit_models(df.limit(0), ["a", "b"]).count() == 0
    alone = FT.fit_models(df.withColumn("fold", F.lit(1)), ["a", "b"], (0.1,)).collect()
    assert [(r["intercept"], r["coefficients"]) for r in alone] == [(0.0, [0.0, 0.0])]
    parted = spark.createDataFrame([(float(k), k % 7 * 1.0, 7.0, int(k >= 20), k % 2) for k in range(40)], SCHEMA)
    assert FT.fit_models(parted, ["a"], (0.0,), max_steps=8).filter("not converged").count() == 2


def test_one_pass_a_step_for_all_models(spark, monkeypatch):
    calls = []
    step = FT._step
    monkeypatch.setattr(FT, "_step", lambda *a: calls.append(len(a[-1])) or step(*a))
    got = FT.fit_models(spark.createDataFrame(rows(200), SCHEMA), ["a", "b"], (0.0, 0.1, 1.0)).collect()
    assert calls[0] == 12 and len(calls) == max(r["steps"] for r in got) < 12
