from __future__ import annotations

import os

import pytest

from pickwell import get_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def rows(spark):
    """Values of one column expression over literal inputs, in input order."""

    def evaluate(values, expression, kind="string"):
        data = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(data, f"i int, x {kind}")
        from pyspark.sql import functions as F

        out = df.select("i", expression(F.col("x")).alias("y")).collect()
        return [r.y for r in sorted(out, key=lambda r: r.i)]

    return evaluate
