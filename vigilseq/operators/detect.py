"""Session verdicts from scored events.

Detections have one row per session: (session_id, label, predicted, n_events,
start_ts, end_ts, last_event, alert_pos, alert_ts, alert_event, alert_loss,
max_loss, avg_loss, first_error_pos, first_error_ts, first_error_event).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.functions.text import categorize
from vigilseq.operators.vocab import BROADCAST_EVENTS
from vigilseq.sources.staging import stage


def detect(scored: DataFrame, alert: Column) -> DataFrame:
    """First row per session where ``alert`` holds, with the session's summary.

    One aggregation with map-side combine: "stop at the first alert" is the
    least position among alert rows.
    """
    fields = F.struct("pos", "ts", "event", "loss")
    per = scored.groupBy("session_id").agg(
        F.max("label").alias("label"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max("loss").alias("max_loss"),
        F.avg("loss").alias("avg_loss"),
        F.max(F.struct("pos", "event")).alias("last"),
        F.min(F.when(alert, fields)).alias("alert"),
        F.min(F.when(F.col("label") == 1, F.struct("pos", "ts", "event"))).alias("error"),
    )
    return per.select(
        "session_id",
        "label",
        F.col("alert").isNotNull().cast("int").alias("predicted"),
        "n_events",
        "start_ts",
        "end_ts",
        F.col("last.event").alias("last_event"),
        F.col("alert.pos").alias("alert_pos"),
        F.col("alert.ts").alias("alert_ts"),
        F.col("alert.event").alias("alert_event"),
        F.coalesce("alert.loss", F.lit(0.0)).alias("alert_loss"),
        "max_loss",
        "avg_loss",
        F.col("error.pos").alias("first_error_pos"),
        F.col("error.ts").alias("first_error_ts"),
        F.col("error.event").alias("first_error_event"),
    )


def topk_miss(scored: DataFrame) -> DataFrame:
    """Scored steps whose event is not among the likeliest."""
    return scored.filter(~F.col("in_topk"))


def detect_topk(scored: DataFrame) -> DataFrame:
    """Anomalous when any event misses the Top-K; ``first_anomaly_step`` is one before it, -1 if none."""
    return detect(scored, ~F.col("in_topk")).withColumn(
        "first_anomaly_step", F.coalesce(F.col("alert_pos") - 1, F.lit(-1))
    )


def detect_threshold(scored: DataFrame, threshold: float, skip: int = 3) -> DataFrame:
    """Anomalous when the loss of an event from position ``skip`` on is above the threshold."""
    return detect(scored, (F.col("loss") > threshold) & (F.col("pos") >= skip))


def detect_avg_loss(losses: DataFrame, threshold: float) -> DataFrame:
    """Anomalous when the mean loss of the session is above the threshold."""
    return losses.withColumn("predicted", F.coalesce((F.col("avg_loss") > threshold).cast("int"), F.lit(0)))


def unscorable(detections: DataFrame, skip: int = 3) -> DataFrame:
    """Number of sessions too short to alert, by label."""
    return (
        detections.filter(F.col("n_events") <= skip)
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n_unscorable"))
    )


def unseen_event_alert(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sessions with events outside the normal vocabulary, and how many."""
    known = stage(vocab.select("event"), "known")
    small = known.count() <= BROADCAST_EVENTS
    unseen = events.filter(F.col("event").isNotNull()).join(F.broadcast(known) if small else known, "event", "left_anti")
    return unseen.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_unseen"), F.min("ts").alias("first_unseen_ts"))


def hybrid_detect(
    detections: DataFrame,
    events: DataFrame,
    rare: DataFrame,
    rules: list[tuple[str, str]],
    short: int = 2,
) -> DataFrame:
    """Sequence alert, or a rare event, or for short sessions a rule on the event text."""
    listed = stage(rare.select("event", F.lit(1).alias("_rare")), "rare")
    small = listed.count() <= BROADCAST_EVENTS
    marked = events.join(F.broadcast(listed) if small else listed, "event", "left")
    flags = marked.groupBy("session_id").agg(
        F.max(F.coalesce("_rare", F.lit(0))).alias("rare_hit"),
        F.max((categorize(F.col("event"), rules, "") != "").cast("int")).alias("rule_hit"),
    )
    out = detections.join(flags, "session_id", "left")
    rare_hit = F.coalesce("rare_hit", F.lit(0))
    rule = F.when(F.col("n_events") <= short, F.coalesce("rule_hit", F.lit(0))).otherwise(0)
    return out.select(
        "session_id",
        "label",
        F.col("predicted").alias("sequence_hit"),
        rare_hit.alias("rare_hit"),
        rule.alias("rule_hit"),
        F.greatest("predicted", rare_hit, rule).alias("predicted"),
    )
