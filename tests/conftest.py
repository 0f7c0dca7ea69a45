import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from decoylog.sources.lines import with_file_info  # noqa: E402
from decoylog.sources.parse import parse_events  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("decoylog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    """Raw texts as the lines of one file."""

    def make(values, file_name="live/cowrie.json"):
        rows = [(value, file_name) for value in values]
        return with_file_info(spark.createDataFrame(rows, "value string, file_name string"))

    return make


@pytest.fixture
def events_of(lines_of):
    """Events from dicts; ``timestamp`` defaults to a fixed time."""

    def make(events):
        default = {"timestamp": "2024-01-01T00:00:00.000000Z"}
        return parse_events(lines_of([json.dumps({**default, **event}) for event in events]))

    return make


@pytest.fixture
def geo_rows(spark):
    from decoylog.sources.sample import sample_geo_ranges

    return sample_geo_ranges(spark)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan_of(df):
    """The plan after adaptive execution has run."""
    df.collect()
    return plan_of(df)


@pytest.fixture
def plans():
    return plan_of, final_plan_of
