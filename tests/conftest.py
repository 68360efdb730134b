import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallgrass.session import build_session

    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(base / "warehouse"),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(base / "checkpoint"))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over literals."""

    def run(column, **values):
        df = spark.range(1)
        from pyspark.sql import functions as F

        for name, value in values.items():
            df = df.withColumn(name, F.lit(value))
        return df.select(column.alias("x")).first()["x"]

    return run
