"""Adding up numpy arrays of fixed size that every input partition has counted."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of an array, so that adding up is spread over tasks.
PARTS = 64
#: First, partitions are added up in so many groups each.
GROUPS = 64


def pieces(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Columns ``part`` and ``counts`` with the array in ``PARTS`` equal pieces."""
    return (pa.array(np.arange(PARTS), pa.int32()),
            pa.array([x.astype(np.int32).tobytes() for x in np.split(counts, PARTS)], pa.binary()))


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum over all partitions of arrays written by :func:`pieces`, as int64.

    Two rounds of grouped sums, so a task adds a bounded number of pieces; what the
    driver gets is one array of ``size`` numbers, whatever the input."""
    def add(dtype):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(size // PARTS, np.int64)
            for x in pdf["counts"]:
                total += np.frombuffer(x, dtype)
            return pd.DataFrame({"part": pdf["part"][:1], "counts": [total.tobytes()]})
        return run
    some = parts.withColumn("_of", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    rows = some.select("part", "counts", "_of").groupBy("part", "_of").applyInPandas(add(np.int32), "part int, counts binary") \
        .groupBy("part").applyInPandas(add(np.int64), "part int, counts binary").collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["part"] * (size // PARTS):(r["part"] + 1) * (size // PARTS)] = np.frombuffer(r["counts"], np.int64)
    return out
