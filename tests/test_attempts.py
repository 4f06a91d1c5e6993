"""Attempt summaries, durations (Q3), trimming (Q6), NaN scores (Q32)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attemptlog.functions.timefn import normalise_zone, seconds_between
from attemptlog.operators import attempts as A

T0 = datetime(2024, 3, 1, 10, 0, 0)
SCHEMA = "student_id string, problem_id long, ord long, ts timestamp, score double"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_summary_basic(spark):
    rows = [("a", 1, 1, T0, 10.0), ("a", 1, 2, T0 + timedelta(seconds=30), 100.0),
            ("a", 1, 3, T0 + timedelta(seconds=100), 50.0),
            ("b", 1, 4, T0, 100.0), ("b", 2, 5, T0, 20.0), ("b", 2, 6, T0 + timedelta(minutes=5), 30.0)]
    s = {(r["student_id"], r["problem_id"]): r for r in
         A.summarize_attempts(_df(spark, rows), ["student_id", "problem_id"], ["ord"]).collect()}
    a = s[("a", 1)]
    assert (a["num_snapshots"], a["max_score"], a["best_pos"], a["time_to_solve"], a["max_gap"]) == (3, 100.0, 2, 100, 70)
    assert a["mean_gap"] == 50.0 and a["success"] is False          # last attempt is 50
    assert s[("b", 1)]["success"] is True and s[("b", 1)]["max_gap"] is None
    assert s[("b", 2)]["time_to_solve"] == 300
    any_ = A.summarize_attempts(_df(spark, rows), ["student_id", "problem_id"], ["ord"], success="any")
    assert {r["student_id"]: r["success"] for r in any_.filter("problem_id = 1").collect()}["a"] is True


def test_durations_wrap_day(spark):
    # Q3: 2 days + 7 s -> 7 with the literal rule; -5 s -> 86395
    df = spark.createDataFrame([(T0 + timedelta(days=2, seconds=7), T0),
                                (T0 - timedelta(seconds=5), T0)], "b timestamp, a timestamp")
    r = df.select(seconds_between("b", "a").alias("x"), seconds_between("b", "a", True).alias("y")).collect()
    assert [(x["x"], x["y"]) for x in r] == [(172807, 7), (-5, 86395)]


def test_trim_modes(spark):
    rows = [("a", 1, 1, T0, 40.0), ("a", 1, 2, T0, 80.0), ("a", 1, 3, T0, 80.0), ("a", 1, 4, T0, 10.0),
            ("b", 1, 5, T0, 20.0), ("b", 1, 6, T0, 100.0), ("b", 1, 7, T0, 100.0)]
    r = A.attempt_rows(_df(spark, rows), ["student_id", "problem_id"], ["ord"])
    trimmed = A.trim_after_best(r, "all")
    assert sorted(x["ord"] for x in trimmed.collect()) == [1, 2, 5, 6]   # first maximum
    kept = {x["ord"]: x["code_kept"] for x in A.trim_after_best(r, "code_if_perfect").collect()}
    assert kept == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}
    once = A.trim_after_best(A.attempt_rows(trimmed.select(*_df(spark, rows).columns),
                                            ["student_id", "problem_id"], ["ord"]), "all")
    assert sorted(x["ord"] for x in once.collect()) == [1, 2, 5, 6]       # idempotent


def test_nan_score_is_null(spark):
    from attemptlog.sources.views import _score
    df = spark.createDataFrame([(float("nan"),), (3.0,)], "v double")
    assert [r[0] for r in df.select(_score(F.col("v"))).collect()] == [None, 3.0]


def test_first_per_key(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, "b")], "k string, o long, v string")
    got = {r["k"]: r["v"] for r in A.first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"x": "a", "y": "b"}


def test_zone_rule(spark):
    # Q27: '0' is US/Eastern wall time (winter -5 h, summer -4 h), others stay
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0), "0"), (datetime(2024, 7, 1, 0, 0), "0"),
                                (datetime(2024, 1, 1, 0, 0), "UTC"), (datetime(2024, 1, 1, 0, 0), "x")],
                               "ts timestamp, z string")
    got = [r[0] for r in df.select(normalise_zone("ts", "z")).collect()]
    assert got == [datetime(2024, 1, 1, 5), datetime(2024, 7, 1, 4), datetime(2024, 1, 1), datetime(2024, 1, 1)]


def test_filters(spark):
    df = spark.createDataFrame([(1, 5, 600), (1, 10, 601), (2, 1, None)], "p long, num_snapshots long, max_gap long")
    assert A.filter_attempts(df, 2, 10).count() == 2
    assert A.without_breaks(df, 600, True).count() == 1
    assert A.without_breaks(df, 601, False).count() == 1
