"""Small helpers of the inventory: P4, P6-P8, P11-P13, F3, F13, F15, S2."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from attemptlog.functions.timefn import parse_time
from attemptlog.operators import attempts as A
from attemptlog.operators import skills as SK
from attemptlog.sources import files as IO


def test_projection_helpers(spark):
    df = spark.createDataFrame([(487.0, 102, 100.0, [1.0, 100.0], "lab", None)],
                               "AssignmentID double, ProblemID long, score double, scores array<double>, type string, flag int")
    r = A.to_common_names(df, {"AssignmentID": "assignment_id", "ProblemID": "problem_id"})
    r = A.problem_key(A.binarize_score(r), "assignment_id", "problem_id")
    row = A.fill_zero(A.has_perfect(r), ["flag"]).collect()[0]
    assert row["problem_key"] == "487.0 102" and row["correct"] == 1 and row["success"] is True
    assert row["flag"] == 0
    assert A.exclude_sentinel(spark.createDataFrame([([-1.0],), ([2.0],)], "scores array<double>")).count() == 1
    assert A.filter_question_type(df.withColumnRenamed("type", "type"), ["skill"]).count() == 0
    hist = spark.createDataFrame([([[1.0]] * 30,), ([[1.0]] * 50,), ([[1.0]] * 29,)], "prev_scores array<array<double>>")
    assert A.filter_history(hist, 30, 50).count() == 1


def test_parse_time_and_latents(spark):
    df = spark.createDataFrame([("2024-02-03 04:05:06",)], "t string")
    assert df.select(parse_time("t")).collect()[0][0] == datetime(2024, 2, 3, 4, 5, 6)
    x = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[2.0], [3.0]], [0.5, 1.0])],
                              "prev_comp_cons array<array<double>>, prev_scores array<array<double>>, sim array<double>")
    r = SK.raw_skills(x, size=2, n=2).collect()[0]
    assert r["skills_raw"] == [2.0, 3.0]
    r = SK.raw_skills(x, size=2, n=2, similarity="sim").collect()[0]
    assert r["skills_raw"] == [1.0, 3.0]                     # F15: similarity-weighted scores
    r = SK.raw_skills(x, size=2, n=2, latents=True).collect()[0]
    assert r["skills_raw"] == [2.0, 3.0, 5.0, 5.0, 5.0]      # F13: three ones appended


def test_read_questions_lowercases(spark, tmp_dir):
    p = os.path.join(tmp_dir, "q.csv")
    with open(p, "w") as fh:
        fh.write('id,type,prompt\nA1_Dorms,lab,"multi\nline"\n')
    r = IO.read_questions(spark, p, lower_id="id").collect()[0]
    assert r["id"] == "a1_dorms" and r["prompt"] == "multi\nline"
    _ = F


def test_scratch_tables_are_deleted(spark):
    from attemptlog.session import cut_lineage, scratch_tables
    with scratch_tables(spark):
        t = cut_lineage(spark.range(5))
        path = t.inputFiles()[0].replace("file://", "")
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
