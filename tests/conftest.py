import os
import sys

import pytest
from pyspark.sql import Column, functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexmill.session import build_session, ship_with_closures  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ship_with_closures()
    session = build_session(
        "local[8]", "lexmill-tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over one row of named values."""

    def run(build, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
        if not isinstance(build, Column):
            build = build(F.col("t"))
        return df.select(build.alias("r")).first()[0]

    return run
