from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidyloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def text(spark):
    """Make a text table from rows; the first column ``k`` is its integer key."""

    def make(columns, rows):
        schema = "k bigint, " + ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)

    return make


@pytest.fixture
def column(spark):
    """Apply a column function to a list of cells."""
    from pyspark.sql import functions as F

    def run(cells, function):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
        rows = df.select("i", function(F.col("c")).alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
