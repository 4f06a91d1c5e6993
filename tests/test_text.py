"""Prompt cleaning (Q29), JSON answers (F20-F22, Q33), constructs (F8, Q28,
Q35, Q36) and line diffs (Q18, Q19) against plain Python."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from attemptlog.functions.catalogues import JAVA_RAW, JAVA_SHARED, PYTHON_RAW, PYTHON_SHARED
from attemptlog.functions.textfn import clean_prompt, first_brace_block
from attemptlog.operators import constructs as K
from attemptlog.operators import jobs as D
from attemptlog.operators import rubric as R


def test_clean_prompt(spark):
    df = spark.createDataFrame([("intro PROBLEM STATEMENT: x PROBLEM STATEMENT:  Do it. \n",),
                                ("plain text",)], "p string")
    got = [r[0] for r in df.select(clean_prompt("p")).collect()]
    assert got == [" Do it. \n".strip(), "plain text"]


def test_first_brace_block(spark):
    df = spark.createDataFrame([('x {"a": 1}\n{"b": 2}',), ("none",), ("{\n}",)], "t string")
    assert [r[0] for r in df.select(first_brace_block("t")).collect()] == ['{"a": 1}', "", "{\n}"]


ANSWERS = [
    ('Scores: {"Decomposition": 3, "Algorithmic Design": 4, "Reading Comprehension": 5}', (3.0, 4.0, 5.0)),
    ('```json\n{"decomposition": 2, "algorithmic_design": 1, "reading_comprehension": 2}\n```', (2.0, 1.0, 2.0)),
    ('{"DECOMPOSITION": 1, "ALGORITHMIC_DESIGN": 0, "algorithmic design": 5, "reading comprehension": 4}', (1.0, 5.0, 4.0)),
    ('{"decomposition": 3, broken', (None, None, None)),
    ("no json here", (None, None, None)),
    ('{"décomposition": 2, "decomposition": 4}', (4.0, None, None)),
]


def test_parse_rubric(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "position long, answer string")
    got = {r["position"]: (r["decomposition"], r["alg"], r["reading"])
           for r in R.parse_rubric(df).collect()}
    for i, (_, exp) in enumerate(ANSWERS):
        assert got[i] == exp, (i, got[i], exp)
    retries = R.rubric_retries(R.parse_rubric(df).withColumn("attempt", F.lit(0)))
    assert sorted(r["position"] for r in retries.collect()) == [3, 4]


def test_collect_rubric_by_position(spark):
    # Q16: regroup by (student, course, position), whatever the number of tasks
    df = spark.createDataFrame([("s", "c", 2, 3.0, None, 1.0), ("s", "c", 0, 1.0, 2.0, 3.0), ("s", "d", 0, 4.0, 4.0, 4.0),
                                ("t", "c", 0, 5.0, 5.0, 5.0)],
                               "student_id string, course_id string, position long, decomposition double, alg double, reading double")
    got = {(r["student_id"], r["course_id"]): (r["decomposition"], r["alg"]) for r in R.collect_rubric(df).collect()}
    assert got == {("s", "c"): ([1.0, 3.0], [2.0, None]), ("s", "d"): ([4.0], [4.0]), ("t", "c"): ([5.0], [5.0])}


CODES = [
    "public int f(int x) {\n  if (x > 0) {\n    if (x > 5) { return 1; }\n  }\n  return 0;\n}",
    'String s = "a" + b; for (int i = 0; i < n; i++) { for (;;) { } } s.length() == t; c == \'x\';',
    "while (k % 2 != 0 && !done) { arr[i + 1] = true; }",
    "x = int(input('n? '))\nfor i in range(3):\n    for j in items:\n        print(i)\n",
    "def f(a, b):\n    d = {1: 2}\n    return [[a]] + list(set(b))\nwith open('f', 'w') as h: pass\n",
    "nothing here at all",
]


@pytest.mark.parametrize("catalogue", [JAVA_RAW, JAVA_SHARED, PYTHON_RAW, PYTHON_SHARED])
def test_detect_matches_python_re(spark, catalogue):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES)], "i long, code string")
    got = {r["i"]: sorted(r["found"]) for r in df.select("i", K.detect("code", catalogue).alias("found")).collect()}
    for i, code in enumerate(CODES):
        exp = sorted(n for n, p in catalogue.items() if re.search(p, code, re.IGNORECASE | re.DOTALL))
        assert got[i] == exp, (i, got[i], exp)


def test_arithmetic_construct_matches_any_word(spark):
    # Q35: the arithmetic detector fires on any text with a word character
    df = spark.createDataFrame([("a",), ("+ -",)], "code string")
    got = [sorted(r[0]) for r in df.select(K.detect("code", {"stat_calculate": PYTHON_RAW["stat_calculate"]})).collect()]
    assert got == [["stat_calculate"], []]


def test_missing_constructs_literal_key(spark):
    # Q36: a required flag without a pattern of the same name is always missing
    tasks = spark.createDataFrame([(1, "x = [1]", 1)], "problem_id long, final_text string, success long")
    q = spark.createDataFrame([(1, 1, 1)], "id long, List long, IfElse long")
    m = K.missing_constructs(tasks, q, PYTHON_SHARED, ["List", "IfElse"]).collect()[0]
    assert m["missing"] == ["List", "IfElse"]
    share = K.missing_construct_share(K.missing_constructs(tasks, q, PYTHON_SHARED, ["List", "IfElse"]))
    assert sorted((r["construct"], r["share"]) for r in share.collect()) == [("IfElse", 0.5), ("List", 0.5)]


PAIRS = [("a\nb\nc", "a\nb\nc"), ("a\nb", "a\nc"), ("", "x\ny"), ("a\nb\nc", ""), ("x", "x\ny\nz")]


def _brute(a, b, headers):
    d = i = 0
    for k, line in enumerate(difflib.unified_diff(a.splitlines(), b.splitlines())):
        if not headers and k < 2:
            continue
        if line.startswith("-"):
            d += 1
        elif line.startswith("+"):
            i += 1
    return d, i


@pytest.mark.parametrize("headers", [False, True])
def test_line_diff(spark, headers):
    df = spark.createDataFrame(PAIRS, "prev string, cur string")
    got = [(r[0]["deleted"], r[0]["inserted"]) for r in df.select(D.line_diff("prev", "cur", headers)).collect()]
    assert got == [_brute(a, b, headers) for a, b in PAIRS]
    if headers:   # Q18: the literal count is one too high on each side of a non-empty diff
        assert got[1] == (2, 2) and got[0] == (0, 0)


def test_line_diff_counts_lines_that_look_like_headers(spark):
    pairs = [("a\n--i;\nb", "a\nb"), ("a\nb", "a\n++i;\nb"), ("-- x", "++ x")]
    df = spark.createDataFrame(pairs, "prev string, cur string")
    got = [(r[0]["deleted"], r[0]["inserted"]) for r in df.select(D.line_diff("prev", "cur", False)).collect()]
    assert got == [(1, 0), (0, 1), (1, 1)]


def test_deeply_nested_code_does_not_end_the_job(spark):
    deep = "x = a" + ".b" * 5000
    df = spark.createDataFrame([(1, deep), (2, "y = f(1) + 2")], "code_id long, code string")
    got = {r["code_id"]: r["n_paths"] for r in D.ast_paths(df).collect()}
    assert set(got) == {1, 2} and got[2] > 0


def test_default_encoder_is_normalised(spark):
    df = spark.createDataFrame([("if x: Y = x",), ("",), ("IF X y x",)], "code string")
    got = {r["code"]: list(r["vector"]) for r in D.embed_texts(df, dim=8).collect()}
    assert got["if x: Y = x"] == got["IF X y x"] and sum(v * v for v in got["IF X y x"]) == pytest.approx(1.0, abs=1e-5)
    assert got[""] == [0.0] * 8


def test_changed_lines_elementwise(spark):
    # Q19: changed = per-step max(deleted, inserted)
    rows = [(1, i + 1, t) for i, t in enumerate(["a", "a\nb\nc", "x"])]
    from attemptlog.operators.sequence import sequenced
    s = sequenced(spark.createDataFrame(rows, "group_id long, ord long, code string"), ["group_id"], ["ord"], carry=["code"])
    got = [r["changed"] for r in D.line_changes(s).orderBy("pos").collect()]
    assert got == [2, 3]
