"""File-stream adapters around the batch operators."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def attempt_stream(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over a folder of attempt files (explicit schema)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.load(path)


def write_row_wise(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], out_path: str,
                   checkpoint: str, trigger_once: bool = True):
    """Append ``fn(stream)`` to a Parquet folder.  ``fn`` must treat each row by
    itself (filters, projections, label and score columns): an ordered or
    aggregating operator would give half answers for a task whose attempts arrive
    in two batches, and Spark rejects it here, as the plan runs on the stream."""
    w = fn(stream).writeStream.format("parquet").option("path", out_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
