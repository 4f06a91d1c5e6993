"""Explicit schemas, the column vocabulary and the concept map.

Every reader takes one of these schemas; nothing is inferred and no column is
picked by position.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column vocabulary shared by all operators (one row = one attempt).
# ---------------------------------------------------------------------------
STUDENT = "student_id"
COURSE = "course_id"
PROBLEM = "problem_id"
ORD = "ord"
TS = "ts"
SCORE = "score"
CODE_ID = "code_id"
CODE = "code"

DEFAULT_KEYS = (STUDENT, PROBLEM)

# Dataset A inputs
EVENT_LOG = T.StructType([
    T.StructField("Order", T.LongType()),
    T.StructField("SubjectID", T.StringType()),
    T.StructField("CourseSectionID", T.StringType()),
    T.StructField("EventType", T.StringType()),
    T.StructField("ServerTimestamp", T.StringType()),
    T.StructField("ServerTimezone", T.StringType()),
    T.StructField("AssignmentID", T.DoubleType()),
    T.StructField("ProblemID", T.LongType()),
    T.StructField("CodeStateID", T.StringType()),
    T.StructField("Score", T.DoubleType()),
])

CODE_STATES = T.StructType([
    T.StructField("CodeStateID", T.StringType()),
    T.StructField("Code", T.StringType()),
])

TASK_LABELS = T.StructType([
    T.StructField("SubjectID", T.StringType()),
    T.StructField("AssignmentID", T.DoubleType()),
    T.StructField("ProblemID", T.LongType()),
    T.StructField("Label", T.BooleanType()),
])

# Dataset B inputs
SUBMISSIONS = T.StructType([
    T.StructField("row_index", T.LongType()),
    T.StructField("student_id", T.StringType()),
    T.StructField("course_id", T.StringType()),
    T.StructField("problem_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("clean_code", T.StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's: the concept map.
# Concept order, then for each dataset the raw 0/1 flag columns per concept.
# ---------------------------------------------------------------------------
CONCEPTS = [
    "IfElse", "Loops", "MathOperations", "LogicOperations", "StringOperations",
    "List", "FileOperations", "Functions", "Dictionary", "Tuple",
]

CONCEPT_MAP = {
    "falcon": {
        "IfElse": ["conditional"],
        "Loops": ["loop_counting", "loop_until", "loop_elements", "loop_nested"],
        "MathOperations": ["stat_calculate", "assignment"],
        "LogicOperations": [],
        "StringOperations": ["input_str", "input_cast", "output"],
        "List": ["list", "list_2d"],
        "FileOperations": ["file_read", "file_write"],
        "Functions": ["function_call", "function_def", "function_return"],
        "Dictionary": ["dictionary"],
        "Tuple": ["tuple", "item_set"],
    },
    "codeworkout": {
        "IfElse": ["If/Else", "NestedIf"],
        "Loops": ["While", "For", "NestedFor"],
        "MathOperations": ["Math+-*/", "Math%"],
        "LogicOperations": ["LogicAndNotOr", "LogicCompareNum", "LogicBoolean"],
        "StringOperations": ["StringFormat", "StringConcat", "StringIndex", "StringLen",
                             "StringEqual", "CharEqual"],
        "List": ["ArrayIndex"],
        "FileOperations": [],
        "Functions": ["DefFunction"],
        "Dictionary": [],
        "Tuple": [],
    },
}

# Raw flag columns of each dataset's questions table, in file order.
FLAGS_B = ["conditional", "loop_counting", "loop_until", "loop_elements", "loop_nested",
           "stat_calculate", "assignment", "input_str", "input_cast", "output", "list",
           "list_2d", "file_read", "file_write", "function_call", "function_def",
           "function_return", "dictionary", "tuple", "item_set"]
FLAGS_A = ["If/Else", "NestedIf", "While", "For", "NestedFor", "Math+-*/", "Math%",
           "LogicAndNotOr", "LogicCompareNum", "LogicBoolean", "StringFormat",
           "StringConcat", "StringIndex", "StringLen", "StringEqual", "CharEqual",
           "ArrayIndex", "DefFunction"]

# Rubric (three skills scored 1..5; averages divide by 5).
RUBRIC_SKILLS = ["decomposition", "alg", "reading"]
RUBRIC_MAX = 5.0

# Experiment constants.
HISTORY_LEN = 30
TARGET_LAST = 50
LAST_SNAPSHOTS = 100
N_FOLDS = 5
THRESHOLD_A = 0.25
THRESHOLD_B = 0.4


def load_concepts(path: str) -> dict:
    """Read a concept-map JSON (driver-side metadata, a few hundred bytes)."""
    with open(path, "r", encoding="utf-8") as fh:
        data = json.load(fh)
    order = data.get("programming_concepts", CONCEPTS)
    return {"order": order, **{k: v for k, v in data.items() if k != "programming_concepts"}}
