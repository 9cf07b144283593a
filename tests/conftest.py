"""One Spark session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """A small local session."""
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame(schema, *rows)`` builds a DataFrame."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


def rows_of(df, *order):
    """Sorted tuples of a DataFrame."""
    picked = df.select(*order) if order else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple(map(str, t)))
