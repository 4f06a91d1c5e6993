"""Registry of named queries: a Spark builder plus (optionally) DuckDB SQL.

Outputs are made hash-comparable with :func:`finalize`: doubles rounded to six
places, integers and booleans as BIGINT, timestamps as epoch microseconds.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
CHECK: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType, T.LongType, T.BooleanType)):
            c = c.cast("long")
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        cols.append(c.alias(f.name))
    return df.select(*cols)
