"""Reports kept up on a live stream: gap sessions, category counts per window, late rows.

Every micro-batch writes its rows to a folder of its own, which a repeated batch
overwrites, so nothing is counted twice.  Readers put the batches together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vigilseq.operators.ordered import running_totals

NOW = {"availableNow": True}


def _start(rows: DataFrame, mode: str, path: str, trigger: dict) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/progress")
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def stream_gap_sessions(stream: DataFrame, key: str, gap_seconds: int, path: str, watermark: str, **trigger) -> StreamingQuery:
    """Sessions of a key broken by a pause longer than the gap, written once the watermark has passed their end.

    Rows may be late by ``watermark``.  A pause of exactly the gap does not break a session.
    """
    window = F.session_window("ts", f"{gap_seconds} seconds 1 microsecond")
    found = stream.withWatermark("ts", watermark).groupBy(F.col(key), window.alias("_window"))
    rows = found.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n_events"), F.max("label").alias("label"))
    return _start(rows.drop("_window"), "append", path, trigger)


def read_gap_sessions(spark: SparkSession, path: str, key: str, key_type: str) -> DataFrame:
    """(key, gap_no, start_ts, end_ts, n_events, label) of the sessions that have ended."""
    rows = spark.read.schema(f"`{key}` {key_type}, start_ts timestamp, end_ts timestamp, n_events bigint, label int").parquet(f"{path}/rows/*")
    return running_totals(rows, [key], ["start_ts"], {"gap_no": F.lit(1)})


def stream_category_timeline(stream: DataFrame, category: Column, path: str, watermark: str, width: str = "1 hour", **trigger) -> StreamingQuery:
    """Anomalous rows per time window and category; a micro-batch writes the counts that it changed."""
    rows = stream.filter("label = 1").withWatermark("ts", watermark)
    counts = rows.groupBy(F.window("ts", width).alias("w"), category.alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return _start(counts.select(F.col("w.start").alias("window_start"), "category", "count"), "update", path, trigger)


def read_category_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Last count of every window and category."""
    rows = spark.read.schema("window_start timestamp, category string, count bigint, batch bigint").parquet(f"{path}/rows")
    return rows.groupBy("window_start", "category").agg(F.max_by("count", "batch").alias("count"))
