"""Metrics against brute force (AUC pairwise, ROC points), Q22, Q23."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attemptlog.operators import metrics as M


def _pairwise_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40))
def test_auc_equals_pairwise(spark_session_for_hypothesis, rows):
    data = [(float(y), p / 6.0) for y, p in rows]
    df = spark_session_for_hypothesis.createDataFrame(data, "y_true double, y_prob double")
    got = M.roc_auc(df).collect()[0][0]
    exp = _pairwise_auc([(int(y), p) for y, p in data])
    assert (got is None and exp is None) or abs(got - exp) < 1e-12


def test_auc_invariant_under_monotone_map(spark):
    rnd = random.Random(3)
    data = [(float(rnd.randint(0, 1)), rnd.random()) for _ in range(200)]
    a = M.roc_auc(spark.createDataFrame(data, "y_true double, y_prob double")).collect()[0][0]
    b = M.roc_auc(spark.createDataFrame([(y, p ** 3) for y, p in data], "y_true double, y_prob double")).collect()[0][0]
    assert abs(a - b) < 1e-12


def test_threshold_is_strict(spark):
    # Q22: a score equal to the threshold is negative
    df = spark.createDataFrame([(1.0, 0.5), (0.0, 0.5), (1.0, 0.9), (0.0, 0.1)], "y_true double, y_prob double")
    cm = M.confusion_matrix(df, 0.5).collect()[0]
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (2, 0, 1, 1)
    m = M.classification_metrics(df, 0.5).collect()[0]
    assert m["precision"] == 1.0 and m["recall"] == 0.5 and abs(m["f1"] - 2 / 3) < 1e-12


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.2)], "y_true double, y_prob double")
    m = M.classification_metrics(df, 0.5).collect()[0]
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    assert M.roc_auc(df).collect()[0][0] is None


def _roc_brute(data, drop):
    scores = sorted({p for _, p in data}, reverse=True)
    P = sum(1 for y, _ in data if y == 1)
    N = len(data) - P
    tps, fps = [], []
    for s in scores:
        tps.append(sum(1 for y, p in data if y == 1 and p >= s))
        fps.append(sum(1 for y, p in data if y == 0 and p >= s))
    keep = list(range(len(scores)))
    if drop and len(scores) > 2:
        keep = [0] + [i for i in range(1, len(scores) - 1)
                      if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) != 0 or (tps[i + 1] - 2 * tps[i] + tps[i - 1]) != 0] \
            + [len(scores) - 1]
    pts = [(float("inf"), 0.0, 0.0)] + [(scores[i], fps[i] / N, tps[i] / P) for i in keep]
    return pts


def test_roc_curve_and_youden(spark):
    rnd = random.Random(11)
    data = [(float(rnd.randint(0, 1)), rnd.randint(0, 8) / 8) for _ in range(60)]
    df = spark.createDataFrame(data, "y_true double, y_prob double")
    for drop in (True, False):
        got = [(r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_curve(df, drop_intermediate=drop).orderBy("idx").collect()]
        exp = _roc_brute(data, drop)
        assert len(got) == len(exp)
        for g, e in zip(got, exp):
            assert g[0] == e[0] and abs(g[1] - e[1]) < 1e-12 and abs(g[2] - e[2]) < 1e-12
    pts = _roc_brute(data, False)
    j = [t - f for _, f, t in pts]
    best = pts[j.index(max(j))][0]
    assert M.youden_threshold(df).collect()[0]["threshold"] == best


def test_fold_average_is_unweighted(spark):
    # Q23: mean of per-fold metrics, not pooled
    data = [("a", 1.0, 0.9), ("a", 0.0, 0.1), ("b", 1.0, 0.9), ("b", 1.0, 0.8), ("b", 1.0, 0.1), ("b", 0.0, 0.2)]
    df = spark.createDataFrame(data, "fold string, y_true double, y_prob double")
    per = {r["fold"]: r["accuracy"] for r in M.metrics_by_group(df, 0.5, ["fold"]).collect()}
    avg = M.average_over_groups(M.metrics_by_group(df, 0.5, ["fold"])).collect()[0]["accuracy"]
    assert abs(avg - (per["a"] + per["b"]) / 2) < 1e-12
    assert abs(M.brier(df).collect()[0][0] - sum((p - y) ** 2 for _, y, p in data) / 6) < 1e-12


def test_auc_is_exact_over_any_ranges(spark):
    rnd = random.Random(9)
    data = [(float(rnd.randint(0, 1)), round(rnd.random(), 3)) for _ in range(300)]
    df = spark.createDataFrame(data, "y_true double, y_prob double")
    exp = _pairwise_auc([(int(y), p) for y, p in data])
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "30"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert abs(M.roc_auc(df).collect()[0][0] - exp) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_curves_of_saturated_scores_and_of_one_group(spark):
    # nearly all scores in two values, and no grouping column at all
    rnd = random.Random(12)
    rows = [(float(rnd.random() < 0.3), rnd.choice([0.0, 1.0, 1.0, rnd.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "y_true double, y_prob double")
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df).collect()[0]["roc_auc"] == pytest.approx(auc)
    pts = M.roc_curve(df, drop_intermediate=False).orderBy("idx").collect()
    want = [(t, sum(p >= t for p in neg) / len(neg), sum(p >= t for p in pos) / len(pos))
            for t in [float("inf"), *sorted({p for _, p in rows}, reverse=True)]]
    assert len(pts) == len(want)
    for r, w in zip(pts, want):
        assert (r["threshold"], r["fpr"], r["tpr"]) == pytest.approx(w)


def test_exact_percentiles_over_ranges(spark):
    from attemptlog.operators.select import exact_percentiles
    rnd = random.Random(2)
    rows = [(g, None if i % 9 == 0 else rnd.choice([rnd.random(), 0.5])) for g in (1, 2) for i in range(rnd.randint(3, 70))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["m"] for r in exact_percentiles(df, ["g"], {"v": "m"}, 0.3).collect()}
    for g in (1, 2):
        v = sorted(x for k, x in rows if k == g and x is not None)
        at = 0.3 * (len(v) - 1)
        lo = int(at)
        assert got[g] == pytest.approx(v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo))
