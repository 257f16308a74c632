import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohortry import Rules  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rules():
    return Rules(as_of=date(2025, 6, 30), run_ts=datetime(2025, 6, 30, 3, 0), order_source="new")


@pytest.fixture
def frame(spark):
    """Rows and a schema string to a data frame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *names):
    """Rows as a sorted list of tuples."""
    picked = df.select(*names) if names else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])


def users(df):
    return {r["user_id"] for r in df.collect()}
