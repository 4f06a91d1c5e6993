"""Labels, validity (Q9), task numbering, histories (Q2) and K2 end to end."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attemptlog.operators import history as H

T0 = datetime(2024, 1, 1)


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 10)], "problem_id long, num_snapshots long")
    assert H.problem_percentile(df, 0.75).collect()[0]["p75"] == 4.75


def test_label_struggle(spark):
    rows = [(s, 1, n, m, "lab") for s, n, m in [("a", 1, 100.0), ("b", 2, 100.0), ("c", 3, 90.0), ("d", 10, 100.0)]]
    df = spark.createDataFrame(rows, "student_id string, problem_id long, num_snapshots long, max_score double, type string")
    got = {r["student_id"]: r["Label"] for r in H.label_struggle(df).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_label_percentile_before_project_filter(spark):
    # Q8: projects count for the percentile, then leave
    rows = [("a", 1, 1, 100.0, "lab"), ("b", 1, 2, 100.0, "project"), ("c", 1, 3, 100.0, "project"),
            ("d", 1, 10, 100.0, "project")]
    df = spark.createDataFrame(rows, "student_id string, problem_id long, num_snapshots long, max_score double, type string")
    out = H.label_struggle(df).collect()
    assert [(r["student_id"], r["p75"]) for r in out] == [("a", 4.75)]


def test_valid_students_rule(spark):
    # Q9: -1 counted over the first 31 tasks in problem order, > 30 is invalid,
    # any valid course admits the student
    rows = []
    for p in range(32):
        rows.append(("x", "c1", p, [-1.0] if p < 31 else [5.0]))     # 31 sentinels in first 31
        rows.append(("y", "c1", p, [-1.0] if p < 30 else [5.0]))     # 30 sentinels
    rows += [("z", "c1", p, [-1.0]) for p in range(32)] + [("z", "c2", 0, [1.0])]
    df = spark.createDataFrame(rows, "student_id string, course_id string, problem_id long, scores array<double>")
    ok = sorted(r[0] for r in H.valid_students(df).collect())
    assert ok == ["y", "z"]


def test_number_and_split(spark):
    rows = [("s", "c", p, T0 + timedelta(hours=p)) for p in range(31)] + \
           [("t", "c", p, T0 + timedelta(hours=p)) for p in range(29)]
    df = spark.createDataFrame(rows, "student_id string, course_id string, problem_id long, end_time timestamp")
    early, late = H.early_late(H.number_tasks(df), 30, 50)
    assert early.filter("student_id = 's'").count() == 30 and late.count() == 1
    assert late.collect()[0]["problem_id"] == 30


def test_history_keeps_missing_slots(spark):
    # Q2: a task without attempts keeps its slot (collect a struct, not a column)
    rows = [("s", "c", 1, 1, [1.0], True, ["a"]), ("s", "c", 2, 2, None, None, None),
            ("s", "c", 3, 3, [3.0], False, ["b"])]
    df = spark.createDataFrame(rows, "student_id string, course_id string, problem_id long, row_number long, "
                                     "scores array<double>, Label boolean, codes array<string>")
    h = H.build_history(df).collect()[0]
    assert h["prev_tasks_id"] == ["1", "2", "3"]
    assert h["prev_scores"] == [[1.0], None, [3.0]] and h["prev_labels"] == [True, None, False]
    assert h["num_tasks"] == 3


def test_last_snapshots_and_truncate(spark):
    df = spark.createDataFrame([([["a", "b", "c"], ["d"], []], [1, 2, 3])], "prev_tasks array<array<string>>, prev_tasks_id array<int>")
    r = H.last_snapshots(df, 2).collect()[0]
    assert r["prev_tasks"] == [["b", "c"], ["d"], []]
    r = H.truncate_history(df, 2, cols=("prev_tasks_id",)).collect()[0]
    assert r["prev_tasks_id"] == [1, 2]


def test_prepare_submissions_small(spark):
    rows = []
    t = T0
    for s in ("a", "b"):
        for p in range(5):
            for k, sc in enumerate([10.0, 100.0, 100.0] if p % 2 == 0 else [30.0, 40.0]):
                t += timedelta(minutes=1)
                rows.append((s, "c", p, t, sc, f"{s}{p}{k}"))
    subs = spark.createDataFrame(rows, "student_id string, course_id string, problem_id long, ts timestamp, "
                                       "score double, code_id string")
    q = spark.createDataFrame([(p, "lab", f"PROBLEM STATEMENT: task {p} ") for p in range(5)],
                              "id long, type string, prompt string")
    out = H.prepare_submissions(subs, q, n_hist=3, n_last=5).orderBy("student_id", "task_number").collect()
    assert len(out) == 4
    r = out[0]
    assert r["prev_tasks_id"] == ["0", "1", "2"] and r["new_task"] == "task 3"
    assert r["prev_scores"][0] == [10.0, 100.0]                  # trimmed at the first maximum
    assert r["prev_tasks"][0] == ["a00", "a01"]
    # P75 of (2, 2, 2, 2, 2, 2) is 2; solved tasks are not struggling -> inverted label False
    assert r["prev_labels"] == [False, True, False]
    _ = F


def test_history_long(spark):
    rows = spark.createDataFrame([("s", "c", 1, 1, 5.0), ("s", "c", 1, 2, 7.0), ("s", "c", 2, 1, 1.0)],
                                 "student_id string, course_id string, problem_id long, pos long, score double")
    num = spark.createDataFrame([("s", "c", 1, 1, True), ("s", "c", 2, 2, False)],
                                "student_id string, course_id string, problem_id long, row_number long, Label boolean")
    out = H.history_long(rows, num, n_hist=1).orderBy("pos").collect()
    assert [(r["task_number"], r["pos"], r["score"]) for r in out] == [(1, 1, 5.0), (1, 2, 7.0)]


def test_task_without_scores_keeps_its_attempts(spark):
    rows = [("s", "c", 1, 1, None), ("s", "c", 1, 2, None), ("s", "c", 2, 3, 100.0), ("s", "c", 2, 4, 50.0)]
    df = spark.createDataFrame(rows, "student_id string, course_id string, problem_id long, ord long, score double") \
        .withColumn("ts", F.timestamp_seconds("ord"))
    t = {r["problem_id"]: r for r in H.task_table(df, ["student_id", "course_id", "problem_id"], ["ord"], code=None,
                                                  sentinel=-1.0).collect()}
    assert t[1]["num_snapshots"] == 2 and t[1]["max_score"] is None and t[1]["scores"] == [None, None]
    assert t[2]["num_snapshots"] == 1 and t[2]["n_sentinel"] == 0
    lab = H.label_struggle(spark.createDataFrame([(1, 2, None), (2, 1, 100.0)],
                                                 "problem_id long, num_snapshots long, max_score double"))
    assert {r["problem_id"]: r["Label"] for r in lab.collect()} == {1: False, 2: True}
