"""attemptlog: Spark-native analytics over attempt logs.

A person tries a task several times; every try leaves an order value, a time,
a score and (optionally) a snapshot of text.  The library orders and nests those
attempts, derives per-task statistics, labels struggling by several definitions,
builds per-person histories, rolls task flags up to concepts, splits people into
folds and scores predictions -- all as DataFrame plans.

Sub-packages
------------
sources    explicit schemas, file readers/writers, views over the driver tables
functions  column-level helpers (time, text, arrays, construct catalogues)
plans      the registered queries and their DuckDB oracle SQL
streaming  file-stream micro-batch wrapper around the batch operators
"""

from attemptlog.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
