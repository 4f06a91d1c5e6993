"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # windows and nested rows cost far more than their shuffled bytes tell
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "attemptlog", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    The session time zone is pinned to UTC: durations and the time-zone rule (F4)
    are defined on UTC instants.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by whoever runs the job (a shared file
    system path).  Only a local-mode session without one (tests, bench) gets a
    fresh private folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    d = tempfile.mkdtemp(prefix="attemptlog-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)   # getCheckpointDir() finds it from now on
    return spark.sparkContext.getCheckpointDir() or d


def cut_lineage(df):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back (never ``localCheckpoint``).

    One computation plus a write, where ``DataFrame.checkpoint`` computes the
    plan once for the action and again to write the files.  Downstream
    branches read the table (with column pruning) instead of re-running the
    upstream plan, and a lost executor only re-reads files.  Tables stay until the
    enclosing :func:`scratch_tables` ends, or for the folder's own retention.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_written: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that the enclosing :func:`scratch_tables` deletes."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession):
    """Delete on exit what :func:`cut_lineage` has written inside.  Results that read
    those tables must be saved or consumed before the block ends."""
    mark = len(_written)
    try:
        yield
    finally:
        gone = _written[mark:]
        del _written[mark:]
        for path in gone:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
