"""Embedding lookup that is added to, load after load.

The table is laid out in a fixed number of hash partitions of the key.  A load
reads and rewrites only the partitions its keys fall in, by dynamic partition overwrite.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attemptlog.operators.jobs import embed_texts
from attemptlog.session import cut_lineage

PARTS = 64      # choose it so that the rows of one partition suit one task


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def _stored(spark: SparkSession, path: str, parts: int) -> DataFrame | None:
    """The stored table with its partition columns; None before the first load."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    stored = spark.read.parquet(path)
    if not stored.filter(F.col("parts") != parts).isEmpty():
        raise ValueError(f"{path} is not laid out in {parts} partitions")
    return stored


def load_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The lookup: one row a key."""
    return spark.read.parquet(path).drop("parts", "part")


def upsert_lookup(spark: SparkSession, path: str, rows: DataFrame, key: str = "code", parts: int = PARTS) -> None:
    """Add ``rows`` (the key and value columns) to the lookup at ``path``; a later load wins.

    Of rows of one load with the same key the greatest values win, so a rerun gives the same
    table; values must be of types that can be ordered.  Null keys cannot be looked up and are left out.  Every load has
    the same columns and ``parts``.  The driver sees the numbers of the partitions touched.  Files
    change only when the job commits; a lost executor costs its tasks.  A driver lost within
    the commit can leave a partition missing: load all sources again then.
    """
    values = [c for c in rows.columns if c != key]
    new = cut_lineage(rows.filter(F.col(key).isNotNull()).withColumn("part", _part(key, parts)))
    touched = sorted(r["part"] for r in new.select("part").distinct().collect())
    if not touched:
        return
    both = new.withColumn("_later", F.lit(1))
    stored = _stored(spark, path, parts)
    if stored is not None:
        old = stored.filter(F.col("part").isin(touched)).drop("parts").withColumn("_later", F.lit(0))
        both = both.unionByName(old)
    last = both.groupBy("part", key).agg(F.max(F.struct("_later", *values)).alias("_v")) \
        .select(F.col(key), *[F.col("_v")[c].alias(c) for c in values], F.lit(parts).alias("parts"), "part")
    last.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("parts", "part").parquet(path)


def embed_new(spark: SparkSession, path: str, snippets: DataFrame, load: int, fn: Callable[[list], list] | None = None,
              dim: int = 64, key: str = "code", parts: int = PARTS) -> None:
    """Embed the distinct snippets that the lookup does not have yet and add them, with the number
    of the ``load``; those it has keep their vector and number.  The encoder sees each text once over all loads."""
    wanted = snippets.select(key).filter(F.col(key).isNotNull()).distinct()
    stored = _stored(spark, path, parts)
    if stored is not None:
        wanted = wanted.join(stored.select(key), key, "left_anti")
    fresh = embed_texts(wanted, fn, dim, key).withColumn("load", F.lit(load))
    upsert_lookup(spark, path, fresh, key, parts)
