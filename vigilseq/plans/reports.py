"""Result tables that reports share: scored events and detections, stored once per state of a log's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseq.functions.text import categorize
from vigilseq.operators.evaluate import grid
from vigilseq.operators.model import score_events
from vigilseq.plans import logs
from vigilseq.plans.detection import fit, stored_contexts, threshold_detections, topk_detections
from vigilseq.sources.staging import staging_path

TOP_K = 12  # the day log has 16 normal symbols, so a small K would flag nearly every session
THRESHOLD = 2.9
SKIP = 3
GRID = grid(2.5, 3.5, 101)
CATEGORY_RULES = [
    ("^error:0$", "read error"),
    ("^error:1$", "write error"),
    ("^error:2$", "link error"),
]

_stored: dict[tuple[str, str, str], str] = {}


def categorized(detections: DataFrame) -> DataFrame:
    return detections.withColumn("category", categorize(F.col("first_error_event"), CATEGORY_RULES))


def _store(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """The named table of a log folder: computed and written on first use, read while the log stays the same."""
    key = (spark.sparkContext.applicationId, folder, f"{name} {logs.version(spark, folder, 'events')}")
    if key not in _stored:
        path = staging_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def topk_table(spark: SparkSession, folder: str) -> DataFrame:
    """Top-K detections of the day log."""
    return _store(
        spark, folder, "topk", lambda: categorized(topk_detections(logs.day_log(spark, folder), 1, TOP_K))
    )


def threshold_table(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold detections of the week log."""
    return _store(
        spark,
        folder,
        "threshold",
        lambda: categorized(threshold_detections(logs.week_log(spark, folder), THRESHOLD, 1, SKIP)),
    )


def scored_table(spark: SparkSession, folder: str) -> DataFrame:
    """Scored events of all splits of the week log."""

    def build() -> DataFrame:
        contexts = stored_contexts(logs.week_log(spark, folder))
        return score_events(contexts, fit(contexts), skip=SKIP)

    return _store(spark, folder, "scored", build)
