"""Splits: pure functions of the session id, the same on every read."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.operators.ordered import quantiles


def hash_pct(key: Column, seed: str = "42") -> Column:
    """Stable percent 0-99 of a key."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8)
    return F.conv(digest, 16, 10).cast("bigint") % 100


def split_name(key: Column, label: Column, cuts=(80, 90), seed: str = "42") -> Column:
    """train / val / test of a normal session; anomalous sessions are always test."""
    pct = hash_pct(key, seed)
    return (
        F.when(label == 1, F.lit("test"))
        .when(pct < cuts[0], F.lit("train"))
        .when(pct < cuts[1], F.lit("val"))
        .otherwise(F.lit("test"))
    )


def split_normal(sessions: DataFrame, cuts=(80, 90), seed: str = "42") -> DataFrame:
    """Split table (session_id, label, split)."""
    return sessions.select(
        "session_id", "label", split_name(F.col("session_id"), F.col("label"), cuts, seed).alias("split")
    )


def split_two(sessions: DataFrame, cut: int = 90, seed: str = "42") -> DataFrame:
    """Train / validation split of the normal sessions."""
    name = F.when(hash_pct(F.col("session_id"), seed) < cut, "train").otherwise("val")
    return sessions.filter("label = 0").select("session_id", name.alias("split"))


def split_windows(windows: DataFrame, cut: int = 80, seed: str = "42") -> DataFrame:
    """Train / validation split of clean windows, by window id."""
    key = F.concat_ws("#", F.col("session_id").cast("string"), F.col("window_no").cast("string"))
    name = F.when(hash_pct(key, seed) < cut, "train").otherwise("val")
    return windows.filter("label = 0").select("session_id", "window_no", name.alias("split"))


def test_set(events: DataFrame, splits: DataFrame) -> DataFrame:
    """Events of the test normals and of all anomalous sessions."""
    normal = splits.filter("label = 0 and split = 'test'").select("session_id")
    anomalous = splits.filter("label = 1").select("session_id")
    return events.join(normal.union(anomalous).distinct(), "session_id", "left_semi")


def split_by_time(sessions: DataFrame, at: datetime.datetime | str) -> DataFrame:
    """Chronological split: sessions that start before ``at`` train, later ones test."""
    name = F.when(F.col("start_ts") < F.lit(at).cast("timestamp"), "train").otherwise("test")
    return sessions.select("session_id", "label", "start_ts", name.alias("split"))


def calibration_set(rows: DataFrame, percent: int = 30, seed: str = "calibrate") -> DataFrame:
    """Rows to calibrate on: the validation split, and a hash part of the anomalous sessions.

    The rows carry ``session_id``, ``label`` of the session and ``split``; the part of the
    anomalous sessions is held out from the final test by ``test_after_calibration``.
    """
    return rows.filter((F.col("split") == "val") | _held_out(percent, seed))


def test_after_calibration(rows: DataFrame, percent: int = 30, seed: str = "calibrate") -> DataFrame:
    """Rows of the test split without those that were calibrated on."""
    return rows.filter((F.col("split") == "test") & ~_held_out(percent, seed))


def _held_out(percent: int, seed: str) -> Column:
    return (F.col("label") == 1) & (hash_pct(F.col("session_id"), seed) < percent)


def split_by_share(sessions: DataFrame, train: float = 0.8) -> DataFrame:
    """Chronological split at the start time before which a share of the sessions lies."""
    starts = sessions.withColumn("_start", F.unix_micros("start_ts"))
    cut = F.broadcast(quantiles(starts, "_start", {"_cut": train}, []))  # one row
    name = F.when(F.col("_start") < F.col("_cut"), "train").otherwise("test")
    return starts.join(cut).select("session_id", "label", "start_ts", name.alias("split"))


def leakage_audit(splits: DataFrame) -> DataFrame:
    """Sessions in more than one split, or anomalous sessions outside the test split."""
    per = splits.groupBy("session_id").agg(
        F.count_distinct("split").alias("n_splits"),
        F.max(F.when((F.col("label") == 1) & (F.col("split") != "test"), 1).otherwise(0)).alias("anomaly_leak"),
    )
    return per.filter("n_splits > 1 or anomaly_leak = 1")
