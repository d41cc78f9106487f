import datetime as dt

import pytest
from pyspark.sql import SparkSession

from vigilseq.sources.staging import release

EVENTS = "session_id string, ts timestamp, tiebreak long, event string, label int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def events(spark):
    """Event table from (session, second, event, label) rows; the input order is the tiebreak."""

    def build(rows):
        start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
        data = [
            (str(s), start + dt.timedelta(seconds=t), i, e, label) for i, (s, t, e, label) in enumerate(rows)
        ]
        return spark.createDataFrame(data, EVENTS)

    return build


LATE_ERROR = [(1, 0, "E1", 0), (1, 10, "E2", 0), (1, 20, "E9", 1), (1, 60, "E2", 0)]
NORMAL = [(2, 0, "E1", 0), (2, 5, "E2", 0), (2, 9, "E2", 0), (2, 12, "E5", 0)]
SHORT = [(3, 0, "E1", 0), (3, 1, "E9", 1)]


@pytest.fixture
def mixed(events):
    return events(LATE_ERROR + NORMAL + SHORT)


@pytest.fixture
def skewed(events):
    """One session with most of the rows."""
    rows = [("hot", i, f"e{i * 7 % 5}", int(i % 50 == 49)) for i in range(400)]
    rows += [(f"s{i % 20}", i, f"e{i % 3}", 0) for i in range(200)]
    return events(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
