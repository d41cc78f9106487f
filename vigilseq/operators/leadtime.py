"""Lead time of alerts before the failure, and its reports.

Positive always means early.  Reports take detections with ``lead_min``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.functions.numeric import (
    OPENSTACK_BANDS,
    OPENSTACK_CUTS,
    band,
    bucketize,
    minutes_between,
    position_pct,
)
from vigilseq.functions.text import pattern_hash
from vigilseq.operators.ordered import quantiles, running_totals

TRUE_POSITIVE = "label = 1 and predicted = 1"


def lead_to_end(detections: DataFrame) -> DataFrame:
    """Minutes from the alert to the session's last event; 0 without an alert."""
    lead = minutes_between(F.col("end_ts"), F.col("alert_ts"))
    return detections.withColumn("lead_min", F.when(F.col("predicted") == 1, lead).otherwise(0.0))


def lead_to_first_error(detections: DataFrame) -> DataFrame:
    """Signed minutes from the alert to the first labelled error; null unless both exist."""
    return detections.withColumn("lead_min", minutes_between(F.col("first_error_ts"), F.col("alert_ts"))).withColumn(
        "lead_sec", F.col("lead_min") * 60
    )


def steps_before_error(detections: DataFrame) -> DataFrame:
    """Events between the alert and the first error."""
    return detections.withColumn("steps_before_error", F.col("first_error_pos") - F.col("alert_pos"))


def lead_interpolated(detections: DataFrame) -> DataFrame:
    """Lead when events have no usable time: the alert is placed by its share of the session."""
    seconds = minutes_between(F.col("end_ts"), F.col("start_ts")) * 60
    at = seconds * F.col("alert_pos") / F.col("n_events")
    to_error = minutes_between(F.col("first_error_ts"), F.col("start_ts"))
    return detections.withColumn("lead_est_min", to_error - at / 60)


def lead_or_estimate(detections: DataFrame) -> DataFrame:
    """Exact leads when the table has any, else the interpolated ones, as ``lead_used_min``."""
    exact = detections.agg(F.count("lead_min").alias("_exact"))  # one row
    used = F.when(F.col("_exact") > 0, F.col("lead_min")).otherwise(F.col("lead_est_min"))
    return lead_interpolated(detections).join(F.broadcast(exact)).withColumn("lead_used_min", used).drop("_exact")


def lead_class(lead: Column) -> Column:
    """Four disjoint classes of a true positive."""
    return (
        F.when(lead > 0, "anticipated").when(lead == 0, "simultaneous").when(lead < 0, "reactive").otherwise("unknown")
    )


def lead_outcome(detections: DataFrame) -> DataFrame:
    """Counts of the four classes over the true positives, and the anticipated share."""
    lead = F.col("lead_min")
    out = detections.filter(TRUE_POSITIVE).agg(
        F.count(F.lit(1)).alias("n_tp"),
        F.count_if(lead > 0).alias("anticipated"),
        F.count_if(lead == 0).alias("simultaneous"),
        F.count_if(lead < 0).alias("reactive"),
        F.count_if(lead.isNull()).alias("unknown"),
    )
    pct = F.when(F.col("n_tp") > 0, 100.0 * F.col("anticipated") / F.col("n_tp")).otherwise(0.0)
    return out.withColumn("anticipated_pct", pct)


def lead_stats(detections: DataFrame, positive_only: bool = False) -> DataFrame:
    """Count, mean, median, min, max and sample deviation of the lead of true positives."""
    leads = detections.filter(TRUE_POSITIVE).filter(F.col("lead_min").isNotNull()).select("lead_min")
    if positive_only:
        leads = leads.filter("lead_min > 0")
    return _with_median(leads, "lead_min", [], _moments("lead_min"), "median_min")


def _moments(column: str) -> list[Column]:
    return [
        F.count(column).alias("n"),
        F.avg(column).alias("mean_min"),
        F.min(column).alias("min_min"),
        F.max(column).alias("max_min"),
        F.stddev_samp(column).alias("std_min"),
    ]


def _with_median(df, column, by, aggregates, name) -> DataFrame:
    stats = df.groupBy(*by).agg(*aggregates)
    median = quantiles(df, column, {name: 0.5}, by)
    if not by:
        stats, median, by = stats.withColumn("_k", F.lit(1)), median.withColumn("_k", F.lit(1)), ["_k"]
    renamed = median.select(*[F.col(k).alias(f"_m_{k}") for k in by], name)
    match = [stats[k].eqNullSafe(renamed[f"_m_{k}"]) for k in by]
    return stats.join(renamed, match, "left").drop("_k", *[f"_m_{k}" for k in by])


def lead_by_category(detections: DataFrame, category: str = "category") -> DataFrame:
    """Lead of true positives per failure category, highest mean first."""
    valid = detections.filter(TRUE_POSITIVE).filter(F.col("lead_min").isNotNull())
    aggregates = [
        F.count(F.lit(1)).alias("count"),
        F.avg("lead_min").alias("mean_min"),
        F.count_if(F.col("lead_min") > 0).alias("anticipated"),
        F.max("lead_min").alias("max_min"),
        F.min("lead_min").alias("min_min"),
        F.avg("steps_before_error").alias("mean_steps"),
    ]
    out = _with_median(valid, "lead_min", [category], aggregates, "median_min")
    pct = F.round(100.0 * F.col("anticipated") / F.col("count"), 1)
    return out.withColumn("pct_anticipated", pct).orderBy(F.desc("mean_min"), category)


def lead_by_event(detections: DataFrame, top: int = 15) -> DataFrame:
    """Lead of true positives per first error event, the ``top`` most frequent."""
    valid = detections.filter(TRUE_POSITIVE).filter(F.col("lead_min").isNotNull())
    aggregates = [
        F.count(F.lit(1)).alias("count"),
        F.avg("lead_min").alias("mean_min"),
        F.count_if(F.col("lead_min") > 0).alias("anticipated"),
        F.min("category").alias("sample_category"),
    ]
    out = _with_median(valid, "lead_min", ["first_error_event"], aggregates, "median_min")
    return out.orderBy(F.desc("count"), "first_error_event").limit(top)


def lead_by_signature(detections: DataFrame, signature: Column) -> DataFrame:
    """True positives per final-log signature: count, best and mean lead, an example and its loss."""
    return (
        detections.filter(TRUE_POSITIVE)
        .withColumn("signature", signature)
        .groupBy("signature")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.max("lead_min").alias("best_lead"),
            F.avg("lead_min").alias("mean_lead"),
            F.min(F.struct("session_id", "alert_loss")).alias("example"),
        )
        .select(
            "signature",
            "count",
            "best_lead",
            "mean_lead",
            F.col("example.session_id").alias("example_id"),
            F.col("example.alert_loss").alias("example_loss"),
        )
        .orderBy(F.desc("count"), "signature")
    )


def failure_diversity(detections: DataFrame, description: Column) -> DataFrame:
    """Distinct failure patterns among the true positives, with an example each."""
    return (
        detections.filter(TRUE_POSITIVE)
        .withColumn("pattern", pattern_hash(description))
        .groupBy("pattern")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min(F.struct("session_id", "first_anomaly_step")).alias("example"),
        )
        .select(
            "pattern",
            "count",
            F.col("example.session_id").alias("example_id"),
            F.col("example.first_anomaly_step").alias("example_step"),
        )
    )


def best_leads(detections: DataFrame, n: int = 10) -> DataFrame:
    valid = detections.filter(TRUE_POSITIVE).filter(F.col("lead_min").isNotNull())
    return valid.orderBy(F.desc("lead_min"), "session_id").limit(n)


def worst_leads(detections: DataFrame, n: int = 10) -> DataFrame:
    valid = detections.filter(TRUE_POSITIVE).filter(F.col("lead_min").isNotNull())
    return valid.orderBy("lead_min", "session_id").limit(n)


def _shares(counted: DataFrame, names: list[str]) -> DataFrame:
    """All named groups in order, absent ones with 0, and their share of the total."""
    rows = [(i, n) for i, n in enumerate(names)]
    listed = counted.sparkSession.createDataFrame(rows, "band_no int, band string")
    total = F.sum("count").over(Window.partitionBy())  # over the listed names only
    return (
        listed.join(counted, "band", "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("pct", F.when(total > 0, 100.0 * F.col("count") / total).otherwise(0.0))
    )


def lead_bands(
    detections: DataFrame, cuts: list[float] = OPENSTACK_CUTS, names: list[str] = OPENSTACK_BANDS
) -> DataFrame:
    """True positives per lead-time band with their share."""
    valid = detections.filter(TRUE_POSITIVE).filter(F.col("lead_min").isNotNull())
    counted = valid.groupBy(band(F.col("lead_min"), cuts, names).alias("band")).agg(F.count(F.lit(1)).alias("count"))
    return _shares(counted, names)


def lead_bins(detections: DataFrame, edges: list[float]) -> DataFrame:
    """Positive leads per fixed bin with their share."""
    names = [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:])] + [f"{edges[-1]:g}+"]
    valid = detections.filter(TRUE_POSITIVE).filter("lead_min > 0")
    counted = valid.groupBy(bucketize(F.col("lead_min"), edges).alias("band")).agg(F.count(F.lit(1)).alias("count"))
    return _shares(counted, names)


def histogram(
    df: DataFrame,
    column: str,
    bins: int,
    clip: tuple[float, float] | None = None,
    by: str | None = None,
) -> DataFrame:
    """Equal-width histogram (bin_no 0..bins-1, lo, hi, count); the last bin includes its edge.

    ``clip`` keeps the values between two quantiles before the edges are taken.
    """
    values = df.filter(F.col(column).isNotNull())
    if clip:
        edge = quantiles(values, column, {"_q_lo": clip[0], "_q_hi": clip[1]}, [])
        values = values.join(F.broadcast(edge)).filter(F.col(column).between(F.col("_q_lo"), F.col("_q_hi")))
    bounds = F.broadcast(values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.floor((F.col(column) - F.col("_lo")) / width)
    bin_no = F.when(width > 0, F.least(at, F.lit(bins - 1))).otherwise(0).cast("int")
    keys = [by] if by else []
    return (
        values.join(bounds)
        .withColumn("bin_no", bin_no)
        .groupBy(*keys, "bin_no", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *keys,
            "bin_no",
            (F.col("_lo") + width * F.col("bin_no")).alias("lo"),
            (F.col("_lo") + width * (F.col("bin_no") + 1)).alias("hi"),
            "count",
        )
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Cumulative percent per distinct value."""
    counts = value_frequency(df.filter(F.col(column).isNotNull()), column)
    placed = running_totals(counts, [], [column], {"_below": F.col("count")}, {"_n": F.sum("count")}, summary=True)
    return placed.select(column, (100.0 * (F.col("_below") + F.col("count")) / F.col("_n")).alias("cum_pct"))


def five_number(df: DataFrame, column: str, by: str, top: int | None = None) -> DataFrame:
    """Min, quartiles and max per group; with ``top`` only the largest groups, by median."""
    values = df.filter(F.col(column).isNotNull())
    sizes = values.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    if top:
        sizes = sizes.orderBy(F.desc("count"), by).limit(top)
        values = values.join(F.broadcast(sizes.select(by)), by, "left_semi")
    names = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(values, column, names, [by]).join(sizes, by).orderBy("median", by)


def detection_vs_error(detections: DataFrame) -> DataFrame:
    """Where in the session alert and error lie, in percent."""
    n = F.col("n_events")
    return detections.filter(TRUE_POSITIVE).select(
        "session_id",
        position_pct(F.col("alert_pos"), n).alias("detection_pct"),
        position_pct(F.col("first_error_pos"), n, capped=False).alias("error_pct"),
    )


def loss_vs_lead(detections: DataFrame) -> DataFrame:
    """Alert loss and lead of the true positives that have both."""
    return (
        detections.filter(TRUE_POSITIVE)
        .filter("alert_loss is not null and lead_min is not null")
        .select("session_id", "alert_loss", "lead_min")
    )


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def lead_by_pattern(detections: DataFrame, pattern: str = "category") -> DataFrame:
    """Per failure pattern: anticipated count and share, mean lead of anticipated and of the rest."""
    lead = F.col("lead_min")
    out = detections.filter(TRUE_POSITIVE).groupBy(pattern).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(lead > 0).alias("anticipated"),
        F.avg(F.when(lead > 0, lead)).alias("mean_anticipated"),
        F.avg(F.when(lead <= 0, lead)).alias("mean_not_anticipated"),
    )
    return out.withColumn("rate_pct", 100.0 * F.col("anticipated") / F.col("total"))
