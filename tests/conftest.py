import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pregonero.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                    "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "5000",
                    "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tests-")}
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluates an expression on a column of texts and returns the results in order."""

    def run(expression, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r[0] for r in rows.select(expression(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]

    return run
