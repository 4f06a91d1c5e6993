"""File sources and sinks.

Every reader takes an explicit schema; CSV code text may span lines
(``multiLine`` with ``"`` escapes).  Nested tables go to Parquet, which keeps
arrays and structs natively (the pickle files of the original become Parquet).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlog.functions.textfn import parse_list
from attemptlog.sources.schema import EVENT_LOG


def read_attempts(spark: SparkSession, path, schema: T.StructType = EVENT_LOG,
                  fmt: str = "csv", multiline: bool = False) -> DataFrame:
    """Event log / code table / label tables (CSV with header, or Parquet).

    ``multiline`` is for the code table alone, whose text holds line breaks: such
    a file cannot be split and is one task.  Use Parquet for large ones."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", multiline)
            .option("escape", '"').option("mode", "PERMISSIVE")
            .csv(path))


def read_questions(spark: SparkSession, path, schema: T.StructType | None = None,
                   fmt: str = "csv", lower_id: str | None = None) -> DataFrame:
    """Question table (CSV or Parquet; convert spreadsheets first)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path) if fmt == "parquet" else \
        r.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if lower_id:
        df = df.withColumn(lower_id, F.lower(F.col(lower_id)))
    return df


PATHS = T.StructType([T.StructField("SubjectID", T.StringType()),
                      T.StructField("Code", T.StringType()),
                      T.StructField("RawASTPath", T.StringType())])


def read_paths(spark: SparkSession, path, schema: T.StructType = PATHS) -> DataFrame:
    """S3: tab-separated code-path table; code may hold line breaks, tabs and quotes."""
    return (spark.read.schema(schema).option("header", True).option("sep", "\t")
            .option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_paths(df: DataFrame, path: str) -> None:
    """S3 sink (tab-separated, header, quotes doubled inside quoted fields)."""
    (df.write.mode("overwrite").option("header", True).option("sep", "\t")
     .option("quote", '"').option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def save_prepared(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Persist a prepared (nested) table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_split(splits: DataFrame, path: str) -> None:
    """Split ids as one table ``(student_id, split | fold)`` (Q25)."""
    splits.write.mode("overwrite").parquet(path)


def load_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


SKILL_SCORES = T.StructType([T.StructField("student_id", T.StringType()),
                             T.StructField("decomposition", T.StringType()),
                             T.StructField("alg", T.StringType()),
                             T.StructField("reading", T.StringType())])


def read_skill_scores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Per-student rubric score lists; CSV list text such as
    ``[3, None, 5]`` is parsed to ARRAY<DOUBLE> (F24)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.schema(SKILL_SCORES).option("header", True).option("escape", '"').csv(path)
    for c in ("decomposition", "alg", "reading"):
        df = df.withColumn(c, parse_list(F.col(c)))
    return df


def prepare_courses(frames: Sequence[tuple[str, DataFrame]],
                    prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Prepare each course's table and append them, tagging the course."""
    parts = []
    for course, df in frames:
        out = prepare(df) if prepare else df
        parts.append(out.withColumn("course", F.lit(course)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_courses(spark: SparkSession, paths: Sequence[str], schema: T.StructType = EVENT_LOG,
                 course_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """S9 as one scan: all course files at once, the course taken from the path."""
    df = read_attempts(spark, list(paths), schema)
    return df.withColumn("course", F.regexp_extract(F.input_file_name(), course_pattern, 1))


#: Column with the text of a record that does not fit its schema (NULL for good rows).
BAD_RECORD = "bad_record"


def scan_courses(spark: SparkSession, folders: dict[str, str], schema: T.StructType = EVENT_LOG) -> DataFrame:
    """CSV files with headers of many course folders (course -> folder) as one table that
    keeps what does not parse.

    Columns are matched by name, so folders may order them differently, lack some (NULL) or
    have others (not read).  Adds ``course``, ``file`` (the record's file) and ``bad_record``: the
    text of a record with a wrong number of fields or a value that its type does not take.
    An empty field is NULL.  Split the result with :func:`good_rows` and :func:`quarantine`.

    The driver reads one line a folder, the header, which all files of a folder share; folders
    with equal headers are one scan, and each scan stays split by file blocks."""
    headers: dict[str, list[str]] = {}
    for course, folder in folders.items():
        first = spark.read.text(folder).first()
        headers.setdefault(first[0] if first else "", []).append(course)
    wanted = {f.name: f for f in schema.fields}
    full = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in ("course", "file", BAD_RECORD)]])
    parts = [spark.createDataFrame([], full)]           # folders without a header line add nothing
    headers.pop("", None)
    for header, courses in headers.items():
        names = spark.createDataFrame([(header,)], "h string").select(F.from_csv(
            "h", F.lit(", ".join(f"c{k} STRING" for k in range(header.count(",") + 1))))).first()[0]
        names = [n for n in names if n is not None]
        found = T.StructType([wanted.get(n, T.StructField(n, T.StringType())) for n in names]
                             + [T.StructField(BAD_RECORD, T.StringType())])
        # a record is only known to be bad once all its fields are read
        whole = F.length(F.concat_ws("", *[F.col(n).cast("string") for n in names])) >= 0
        rows = spark.read.schema(found).option("header", True).option("escape", '"').option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", BAD_RECORD).csv([folders[c] for c in courses])
        path = F.col("_metadata.file_path")
        course = F.coalesce(*[F.when(F.contains(path, F.lit(folders[c].rstrip("/") + "/")), F.lit(c)) for c in courses])
        parts.append(rows.select(
            *[F.col(n) if n in names else F.lit(None).cast(f.dataType).alias(n) for n, f in wanted.items()],
            course.alias("course"), F.col("_metadata.file_name").alias("file"),
            F.when(whole, F.col(BAD_RECORD)).alias(BAD_RECORD)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def good_rows(scanned: DataFrame) -> DataFrame:
    """Rows of :func:`scan_courses` that fit the schema."""
    return scanned.filter(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD, "file")


def quarantine(scanned: DataFrame) -> DataFrame:
    """Records of :func:`scan_courses` that do not: course, file, text."""
    return scanned.filter(F.col(BAD_RECORD).isNotNull()).select("course", "file", BAD_RECORD)
