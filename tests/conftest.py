import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leakscan_spark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """(file, text) rows from a dict."""

    def make(rows: dict):
        return spark.createDataFrame(list(rows.items()), "file string, text string").coalesce(1)

    return make


@pytest.fixture(scope="session")
def column(spark):
    """Values of an expression over a list of strings in column x."""

    def evaluate(values, expression):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
        return [r[0] for r in rows.orderBy("i").select(expression).collect()]

    return evaluate
