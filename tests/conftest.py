import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gradeloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "gradeloom-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(spark):
    class Tables:
        def __getattr__(self, name):
            return spark.read.parquet(f"{DATA}/{name}.parquet")

    return Tables()
