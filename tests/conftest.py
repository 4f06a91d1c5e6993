import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from attemptlog.session import get_spark
    ck = tempfile.mkdtemp(prefix="attemptlog-test-ckpt-")
    s = get_spark("local[*]", 8, extra={"spark.checkpoint.dir": ck,
                                        "spark.sql.shuffle.partitions": "8"})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(ck)
    yield s


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="attemptlog-test-")


@pytest.fixture(scope="session")
def spark_session_for_hypothesis(spark):
    return spark
