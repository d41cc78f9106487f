"""Row filters on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal_rows(events: DataFrame) -> DataFrame:
    """Rows labelled normal that carry an event."""
    return events.filter((F.col("label") == 0) & F.col("event").isNotNull())


def filter_label(events: DataFrame, label: int | None = None) -> DataFrame:
    """Optional label filter, then rows that carry an event."""
    if label is not None:
        events = events.filter(F.col("label") == label)
    return events.filter(F.col("event").isNotNull())
