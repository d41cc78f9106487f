"""Column contract shared by all operators.

Every operator after the sources works on these event columns:

    session_id, ts, tiebreak, event, label

``ts`` is a TimestampType, ``label`` the 0/1 label of the row, ``tiebreak`` a
bigint that orders rows of equal time.  ``LogSchema`` says how an input table
names them, which column holds the ``template`` and what else is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_COLUMNS = ["session_id", "ts", "tiebreak", "event", "label"]
EVENT_ORDER = ["ts", "tiebreak"]


@dataclass(frozen=True)
class LogSchema:
    """Names of the log columns in an input table."""

    session: str
    ts: str
    event: str
    label: str
    tiebreak: str | None = None
    ts_kind: str = "timestamp"  # timestamp | text | epoch
    template: str | None = None
    extra: tuple[str, ...] = ()  # further columns, kept under their names

    def columns(self) -> list[str]:
        names = [self.session, self.ts, self.event, self.label]
        return names + [c for c in (self.tiebreak, self.template) if c] + list(self.extra)


# The three log layouts of the reference (fixed column names).
OPENSTACK = LogSchema(
    "test_id", "timestamp", "EventId", "anom_label", ts_kind="text", template="EventTemplate", extra=("Content", "service")
)
HDFS = LogSchema("session_id", "timestamp", "EventTemplate", "anom_label", ts_kind="text")
BGL = LogSchema("node_id", "timestamp", "EventTemplate", "label", ts_kind="epoch")

STRUCTS = {
    "openstack": T.StructType(
        [
            T.StructField("test_id", T.LongType()),
            T.StructField("timestamp", T.StringType()),
            T.StructField("time_hour", T.StringType()),
            T.StructField("EventId", T.StringType()),
            T.StructField("EventTemplate", T.StringType()),
            T.StructField("Content", T.StringType()),
            T.StructField("service", T.StringType()),
            T.StructField("anom_label", T.IntegerType()),
        ]
    ),
    "hdfs": T.StructType(
        [
            T.StructField("session_id", T.StringType()),
            T.StructField("timestamp", T.StringType()),
            T.StructField("EventTemplate", T.StringType()),
            T.StructField("anom_label", T.IntegerType()),
        ]
    ),
    "bgl": T.StructType(
        [
            T.StructField("node_id", T.StringType()),
            T.StructField("timestamp", T.LongType()),
            T.StructField("EventTemplate", T.StringType()),
            T.StructField("label", T.IntegerType()),
        ]
    ),
}


def canonical(df: DataFrame, schema: LogSchema) -> DataFrame:
    """Project an input table to the event columns.

    Text timestamps that do not parse become null.  Without a tiebreak column rows of
    equal time keep the order they have in the input: a running number that grows along
    each file and differs between files.  Its values belong to one read.
    """
    ts = F.col(schema.ts)
    if schema.ts_kind == "epoch":
        ts = F.timestamp_seconds(ts)
    elif schema.ts_kind == "text":
        ts = F.try_to_timestamp(ts)
    else:
        ts = ts.cast("timestamp")
    event = F.col(schema.event).cast("string")
    label = F.col(schema.label).cast("int")
    if schema.tiebreak:
        tiebreak = F.col(schema.tiebreak).cast("bigint")
    else:
        tiebreak = F.monotonically_increasing_id()
    return df.select(
        F.col(schema.session).alias("session_id"),
        ts.alias("ts"),
        tiebreak.alias("tiebreak"),
        event.alias("event"),
        label.alias("label"),
        *([F.col(schema.template).cast("string").alias("template")] if schema.template else []),
        *schema.extra,
    )
