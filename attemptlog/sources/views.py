"""Views that map the driver's tables onto the attempt-log data model.

Each view is a lazy DataFrame over the parquet files, so filters and column
pruning reach the scans.  The same definitions are mirrored as SQL CTEs in
``attemptlog.plans.sqlviews`` for the DuckDB cross-check.

| view            | source                     | mapping                                           |
| attempts        | events                     | student=user_id, problem=props.k, ord=event_id    |
| attempts_deep   | events                     | problem=event_type (long sequences)               |
| attempts_big    | lineitem JOIN orders       | student=o_custkey, course=o_orderpriority,        |
|                 |                            | problem=l_partkey % 100, order=(date, keys...)    |
| snapshots       | conversations              | attempt group=conv_id, order=turn, code=text      |
| code_states     | documents                  | code_id=doc_id, code=text, problem=source         |
| questions       | part                       | id=p_partkey % 100, flags from predicates         |
| vectors         | embeddings                 | id=vec_id, student=label                          |
| predictions     | labels JOIN documents      | y_true=quality, fold=source, prob=n_chars%1000/1000|
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attemptlog.sources.schema import FLAGS_A, FLAGS_B

BIG_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
N_QUESTIONS = 100     # every problem id of the attempts has a question


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _score(c):
    # Q32: NaN scores become NULL on read so max/array_max ignore them.
    return F.when(F.isnan(c), F.lit(None)).otherwise(c).cast("double")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> attempts; many short (student, problem) sequences."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("student_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("problem_id"),
        F.col("event_type"),
        F.col("event_id").alias("ord"),
        F.col("ts"),
        _score(F.least(F.floor("value"), F.lit(100)).cast("double")).alias("score"),
        F.col("event_id").alias("code_id"),
    )


def attempts_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> attempts keyed by (student, event_type): long sequences."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("student_id"),
        F.col("event_type").alias("problem_id"),
        F.col("event_id").alias("ord"),
        F.col("ts"),
        _score(F.least(F.floor("value"), F.lit(100)).cast("double")).alias("score"),
        F.col("event_id").alias("code_id"),
    )


def attempts_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem JOIN orders -> attempts with a course column and a composite order.

    (l_orderkey, l_linenumber) alone is not unique in the driver data, so the
    order ends in l_partkey, l_suppkey.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").alias("student_id"),
        F.col("o_orderpriority").alias("course_id"),
        (F.col("l_partkey") % N_QUESTIONS).alias("problem_id"),
        F.col("o_orderdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        _score(F.round(F.col("l_discount") * 1000)).alias("score"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> ordered text snapshots of one attempt group."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("group_id"),
        F.col("turn").alias("ord"),
        F.col("role"),
        F.col("text").alias("code"),
    )


def code_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("code_id"),
        F.col("text").alias("code"),
        F.col("source").alias("problem_id"),
        "lang", "n_chars",
    )


def _flag_exprs(names):
    # flag j fires for a part of size j+1 whose type is ECONOMY or PROMO.
    out = []
    for j, name in enumerate(names):
        hit = (F.col("p_size") == j + 1) & F.col("p_type").isin("ECONOMY", "PROMO")
        out.append(F.max(F.when(hit, 1).otherwise(0)).cast("int").alias(name))
    return out


def questions(spark: SparkSession, sf_dir: str, flags: str = "B", n: int = N_QUESTIONS) -> DataFrame:
    """part -> one question per id (p_partkey % n) with 0/1 construct flags.

    type comes from the part with the lowest p_partkey of the id (an explicit
    order, never an arbitrary ``first``).
    """
    names = FLAGS_B if flags == "B" else FLAGS_A
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    kind = (F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "skill")
            .when(F.col("p_type").isin("MEDIUM", "PROMO"), "lab")
            .otherwise("project"))
    return (p.groupBy((F.col("p_partkey") % n).alias("id"))
            .agg(F.min_by(kind, F.col("p_partkey")).alias("type"),
                 F.min_by(F.col("p_name"), F.col("p_partkey")).alias("prompt"),
                 *_flag_exprs(names)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("student_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    j = lab.join(doc, "doc_id", "inner")
    return j.select(
        "doc_id",
        F.col("source").alias("fold"),
        F.col("lang").alias("dataset"),
        F.col("quality").cast("double").alias("y_true"),
        ((F.col("n_chars") % 1000) / 1000.0).alias("y_prob"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("student_id"), F.col("event_id").alias("ord"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("problem_id"),
                    F.col("props").alias("answer"))
