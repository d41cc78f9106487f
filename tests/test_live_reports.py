"""Live reports equal their batch operators once the stream has ended, with late rows and repeated batches."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tests.conftest import EVENTS
from vigilseq.operators import evaluate, sessions
from vigilseq.streaming import live_reports

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def write_files(spark, path, parts):
    """One file a micro-batch, and a last row far beyond that moves the watermark past all others."""
    for part in [*parts, [("end", at(10_000_000), 0, "end", 1)]]:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


# Pauses of 99, 100 and 101 seconds; the second and third file hold rows that come late.
PARTS = [
    [("a", at(0), 0, "x", 0), ("a", at(99), 1, "y", 0), ("b", at(10), 2, "x", 1), ("a", at(500), 3, "x", 1)],
    [("a", at(199), 4, "y", 1), ("a", at(601), 5, "x", 0), ("b", at(60), 6, "z", 0), ("c", at(640), 7, "x", 1)],
    [("a", at(550), 8, "x", 0), ("b", at(700), 9, "z", 1), ("b", at(700), 10, "z", 1), ("c", at(741), 11, "y", 0)],
    [("c", at(900), 12, "x", 1), ("b", at(801), 13, "x", 0)],
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame([r for part in PARTS for r in part], EVENTS)


def test_gap_sessions(spark, log, tmp_path):
    stream = write_files(spark, str(tmp_path / "in"), PARTS)
    query = live_reports.stream_gap_sessions(stream, "session_id", 100, str(tmp_path / "out"), "10 minutes", **live_reports.NOW)
    query.awaitTermination()
    names = ["session_id", "gap_no", "start_ts", "end_ts", "n_events", "label"]
    found = live_reports.read_gap_sessions(spark, str(tmp_path / "out"), "session_id", "string")
    wanted = sessions.gap_sessions(log, "session_id", 100)
    assert sorted(map(tuple, found.select(names).collect())) == sorted(map(tuple, wanted.select(names).collect()))
    assert found.filter("session_id = 'a'").count() == 2


def test_category_timeline_and_a_repeated_batch(spark, log, tmp_path):
    path = str(tmp_path / "out")
    stream = write_files(spark, str(tmp_path / "in"), PARTS)

    def run():
        live_reports.stream_category_timeline(stream, F.col("event"), path, "10 minutes", "5 minutes", **live_reports.NOW).awaitTermination()
        found = live_reports.read_category_timeline(spark, path).filter("category <> 'end'")
        return sorted(map(tuple, found.select("window_start", "category", "count").collect()))

    wanted = evaluate.category_timeline(log, F.col("event"), "5 minutes").select("window_start", "category", "count")
    first = run()
    assert first == sorted(map(tuple, wanted.collect()))
    shutil.move(str(tmp_path / "out" / "progress" / "commits" / "4"), str(tmp_path / "commit"))  # the last batch is done again
    assert run() == first
