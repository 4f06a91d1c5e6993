"""Sources and sinks round trips (S1-S10) and the streaming adapter."""

import json
import os

import pytest
from pyspark.sql import functions as F

from attemptlog.sources import files as IO
from attemptlog.sources.schema import CODE_STATES, load_concepts


def test_csv_multiline_code(spark, tmp_dir):
    p = os.path.join(tmp_dir, "code.csv")
    with open(p, "w") as fh:
        fh.write('CodeStateID,Code\n1,"int f() {\n  return ""x"";\n}"\n2,\n')
    df = IO.read_attempts(spark, p, CODE_STATES, multiline=True).orderBy("CodeStateID").collect()
    assert df[0]["Code"] == 'int f() {\n  return "x";\n}' and df[1]["Code"] is None


def test_paths_prepared_split_predictions(spark, tmp_dir):
    paths = spark.createDataFrame([("s", "x = 1", "a,b,c@$d,e,f")], "SubjectID string, Code string, RawASTPath string")
    IO.write_paths(paths, os.path.join(tmp_dir, "paths"))
    assert IO.read_paths(spark, os.path.join(tmp_dir, "paths")).collect()[0]["RawASTPath"] == "a,b,c@$d,e,f"
    nested = spark.createDataFrame([("s", [["a", "b"], []], [[1.0], [2.0, None]])],
                                   "student_id string, prev_tasks array<array<string>>, prev_scores array<array<double>>")
    IO.save_prepared(nested, os.path.join(tmp_dir, "prep"))
    assert IO.load_prepared(spark, os.path.join(tmp_dir, "prep")).collect()[0]["prev_scores"] == [[1.0], [2.0, None]]
    sp = spark.createDataFrame([("s", "train"), ("t", "test")], "student_id string, split string")
    IO.save_split(sp, os.path.join(tmp_dir, "split"))
    assert IO.load_split(spark, os.path.join(tmp_dir, "split")).count() == 2
    pred = spark.createDataFrame([(1.0, 0.7, 1)], "y_true double, y_probs double, y_pred int")
    IO.write_predictions(pred, os.path.join(tmp_dir, "pred"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "pred")).collect()[0]["y_pred"] == "1"


def test_paths_round_trip_with_line_breaks(spark, tmp_dir):
    rows = [("s", 'def f():\n\treturn "x\\n"\n', "a,b,c@$d,e,f"), ("t", "  y = 'q'\n", ""), ("u", None, "a,b,c")]
    paths = spark.createDataFrame(rows, "SubjectID string, Code string, RawASTPath string")
    IO.write_paths(paths, os.path.join(tmp_dir, "p2"))
    back = {r["SubjectID"]: (r["Code"], r["RawASTPath"] or "") for r in IO.read_paths(spark, os.path.join(tmp_dir, "p2")).collect()}
    assert back == {s: (c, p) for s, c, p in rows}


def test_event_log_is_splittable(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ev.csv")
    with open(p, "w") as fh:
        fh.write("CodeStateID,Code\n1,x\n")
    plan = IO.read_attempts(spark, p, CODE_STATES)._jdf.queryExecution().toString()
    assert "multiLine" not in plan or "multiLine -> true" not in plan


def test_skill_scores_list_text(spark, tmp_dir):
    p = os.path.join(tmp_dir, "skills.csv")
    with open(p, "w") as fh:
        fh.write('student_id,decomposition,alg,reading\ns,"[3, None, 5]","[1]","[]"\n')
    r = IO.read_skill_scores(spark, p).collect()[0]
    assert r["decomposition"] == [3.0, None, 5.0] and r["alg"] == [1.0] and r["reading"] == []


def test_prepare_courses_and_concepts(spark, tmp_dir):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, extra string")
    u = IO.prepare_courses([("c1", a), ("c2", b)], prepare=lambda d: d.withColumn("x2", F.col("x") * 2))
    assert sorted((r["course"], r["x2"]) for r in u.collect()) == [("c1", 2), ("c2", 4)]
    p = os.path.join(tmp_dir, "concepts.json")
    with open(p, "w") as fh:
        json.dump({"programming_concepts": ["A", "B"], "falcon": {"A": ["x"], "B": []}}, fh)
    c = load_concepts(p)
    assert c["order"] == ["A", "B"] and c["falcon"]["B"] == []


def test_load_embeddings_later_wins(spark):
    from attemptlog.operators.jobs import load_embeddings
    a = spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "code string, vector array<double>")
    b = spark.createDataFrame([("x", [9.0])], "code string, vector array<double>")
    got = {r["code"]: r["vector"] for r in load_embeddings([a, b]).collect()}
    assert got == {"x": [9.0], "y": [2.0]}


def test_streaming_is_row_wise(spark, tmp_dir):
    from pyspark.errors import AnalysisException

    from attemptlog.operators.attempts import binarize_score, summarize_attempts
    from attemptlog.streaming import attempt_stream, write_row_wise
    src = os.path.join(tmp_dir, "in")
    rows = spark.createDataFrame([("s", 1, 1, 10.0), ("s", 1, 2, 100.0)],
                                 "student_id string, problem_id long, ord long, score double") \
        .withColumn("ts", F.timestamp_seconds(F.col("ord") * 60))
    rows.write.parquet(src)
    stream = attempt_stream(spark, src, rows.schema)
    q = write_row_wise(stream, binarize_score, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "out")).collect()
    assert sorted(r["correct"] for r in out) == [0, 1]
    with pytest.raises(AnalysisException):
        write_row_wise(stream, lambda b: summarize_attempts(b, ["student_id", "problem_id"], ["ord"]),
                       os.path.join(tmp_dir, "o2"), os.path.join(tmp_dir, "c2"))


def test_scan_courses_keeps_bad_records_and_follows_names(spark, tmp_dir):
    import os

    from attemptlog.sources import files as S
    schema = "Order long, SubjectID string, Score double"
    texts = {"a": "Order,SubjectID,Score\n1,x,5.0\n2,\"y, z\",\n3,q\n,,\n",
             "b": "Score,More,Order\n7,m,4\nno,m,5\n1,m,6,7\n", "c": "Order,SubjectID,Score\nten,x,1\n", "d": ""}
    folders = {}
    for course, text in texts.items():
        folders[course] = f"{tmp_dir}/{course}"
        os.makedirs(folders[course])
        with open(f"{folders[course]}/log.csv", "w") as f:
            f.write(text)
    from pyspark.sql import types as T
    scanned = S.scan_courses(spark, folders, T._parse_datatype_string(schema))
    good = {tuple(r) for r in S.good_rows(scanned).select("course", "Order", "SubjectID", "Score").collect()}
    assert good == {("a", 1, "x", 5.0), ("a", 2, "y, z", None), ("a", None, None, None), ("b", 4, None, 7.0)}
    bad = {(r["course"], r["file"], r["bad_record"]) for r in S.quarantine(scanned).collect()}
    assert bad == {("a", "log.csv", "3,q"), ("b", "log.csv", "no,m,5"), ("b", "log.csv", "1,m,6,7"), ("c", "log.csv", "ten,x,1")}
    assert S.quarantine(scanned).groupBy("course").count().count() == 3
