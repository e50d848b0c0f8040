"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tideline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tideline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate an expression of a column ``x`` for one value."""

    def run(value, build, kind="string"):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame([(value,)], f"x {kind}")
        return frame.select(build(F.col("x")).alias("y")).first()[0]

    return run
