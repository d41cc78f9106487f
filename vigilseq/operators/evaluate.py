"""Detector evaluation: counts, metrics, thresholds, profiles and verdicts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.functions.numeric import edges_below
from vigilseq.functions.text import pattern_hash, short_desc
from vigilseq.operators.leadtime import TRUE_POSITIVE, lead_class
from vigilseq.operators.ordered import quantiles
from vigilseq.operators.vocab import with_template


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def confusion(detections: DataFrame) -> DataFrame:
    label, predicted = F.col("label") == 1, F.col("predicted") == 1
    return detections.agg(
        F.count_if(label & predicted).alias("tp"),
        F.count_if(~label & predicted).alias("fp"),
        F.count_if(~label & ~predicted).alias("tn"),
        F.count_if(label & ~predicted).alias("fn"),
    )


def class_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy and specificity; 0 where the denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = conf.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "accuracy": ratio(tp + tn, tp + fp + tn + fn),
            "specificity": ratio(tn, tn + fp),
        }
    )
    return out.withColumn("f1", f1_of("precision", "recall"))


def f1_of(precision: str, recall: str) -> Column:
    p, r = F.col(precision), F.col(recall)
    return ratio(2 * p * r, p + r)


def ksigma_threshold(losses: DataFrame, k: float, column: str = "max_loss") -> DataFrame:
    """mean + k * population deviation of the losses (pass normal sessions)."""
    out = losses.agg(F.avg(column).alias("mean_loss"), F.stddev_pop(column).alias("std_loss"))
    return out.withColumns({"k_sigma": F.lit(float(k)), "threshold": F.col("mean_loss") + k * F.col("std_loss")})


def class_separation(losses: DataFrame) -> DataFrame:
    """Mean and deviation of the highest and the mean loss per class, and the distance of the means."""
    out = []
    for short in ("max", "avg"):
        column = F.col(f"{short}_loss")
        for name, label in (("normal", 0), ("anomaly", 1)):
            value = F.when(F.col("label") == label, column)
            out += [
                F.avg(value).alias(f"{name}_{short}_loss_mean"),
                F.stddev_pop(value).alias(f"{name}_{short}_loss_std"),
            ]
    stats = losses.agg(*out)
    return stats.withColumns(
        {
            f"separation_{s}": F.col(f"anomaly_{s}_loss_mean") - F.col(f"normal_{s}_loss_mean")
            for s in ("max", "avg")
        }
    )


def grid(lo: float, hi: float, n: int) -> list[float]:
    """``n`` evenly spaced thresholds, rounded so that any engine reads the same numbers."""
    return [round(lo + (hi - lo) * i / (n - 1), 6) for i in range(n)]


# Grid of a published sweep (fixed value).
COARSE_GRID = grid(1.0, 20.0, 39)


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and metrics for every threshold of a grid in any order, strict ``score > t``.

    Each score is put in its grid bucket once; the counts above a threshold are
    sums over the buckets, of which there are only as many as thresholds.
    """
    ranked = sorted(range(len(thresholds)), key=lambda i: thresholds[i])
    at = edges_below(F.coalesce(F.col(score), F.lit(0.0)), [thresholds[i] for i in ranked], strict=True)
    buckets = df.groupBy(at.alias("above")).agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )
    rows = [(place, i, float(thresholds[i])) for place, i in enumerate(ranked)]
    listed = df.sparkSession.createDataFrame(rows, "place int, grid_no int, threshold double")
    # Bucket i is above the thresholds 0 .. i-1; the grid is a short list.
    spread = buckets.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))))
    hit = F.col("above") > F.col("place")
    counts = spread.groupBy("place").agg(
        F.sum(F.when(hit, F.col("n1")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n0")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("n0")).otherwise(0)).alias("tn"),
        F.sum(F.when(~hit, F.col("n1")).otherwise(0)).alias("fn"),
    )
    return class_metrics(listed.join(counts, "place").drop("place"))


def calibrate(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """The threshold with the best F1; the lowest one wins ties."""
    return threshold_sweep(df, score, label, thresholds).orderBy(F.desc("f1"), "threshold").limit(1)


def calibrate_k(df: DataFrame, score: str, label: str, ks: Sequence[float]) -> DataFrame:
    """The k of mean + k * deviation with the best F1; the lowest k wins ties.

    The two moments of the normal scores are one row read to the driver.
    """
    row = ksigma_threshold(df.filter(F.col(label) == 0), 0.0, score).first()
    mean, std = row["mean_loss"], row["std_loss"]
    swept = threshold_sweep(df, score, label, [mean + k * std for k in ks])
    listed = df.sparkSession.createDataFrame([(i, float(k)) for i, k in enumerate(ks)], "grid_no int, k_sigma double")
    return swept.join(F.broadcast(listed), "grid_no").orderBy(F.desc("f1"), "k_sigma").limit(1)


def robust_range(sweep: DataFrame, min_f1: float = 0.7, min_width: float = 0.3) -> DataFrame:
    """First and last threshold with F1 above ``min_f1``, the width, and the holes inside."""
    good = F.col("f1") > min_f1
    out = sweep.agg(
        F.min(F.when(good, F.col("threshold"))).alias("robust_min"),
        F.max(F.when(good, F.col("threshold"))).alias("robust_max"),
        F.min(F.when(good, F.col("grid_no"))).alias("_first"),
        F.max(F.when(good, F.col("grid_no"))).alias("_last"),
        F.count_if(good).alias("n_good"),
    )
    width = F.coalesce(F.col("robust_max") - F.col("robust_min"), F.lit(0.0))
    holes = F.coalesce(F.col("_last") - F.col("_first") + 1 - F.col("n_good"), F.lit(0))
    return out.select(
        "robust_min", "robust_max", width.alias("width"), "n_good", holes.alias("holes"), (width > min_width).alias("passed")
    )


def trivial_baselines(detections: DataFrame) -> DataFrame:
    """Majority class and all-positive next to the model, with the model's gain over the best."""
    model = class_metrics(confusion(detections))
    n1, n0 = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    prevalence = ratio(n1, n0 + n1)
    out = model.select(
        F.when(n0 >= n1, 0.0).otherwise(ratio(2 * prevalence, prevalence + 1)).alias("majority_f1"),
        ratio(F.greatest(n0, n1), n0 + n1).alias("majority_accuracy"),
        ratio(2 * prevalence, prevalence + 1).alias("all_positive_f1"),
        prevalence.alias("all_positive_accuracy"),
        F.col("f1").alias("model_f1"),
        F.col("accuracy").alias("model_accuracy"),
    )
    best = F.greatest("majority_f1", "all_positive_f1")
    return out.withColumns({"improvement": F.col("model_f1") - best, "passed": F.col("model_f1") > best})


def percentiles(
    df: DataFrame, column: str, by: Sequence[str], qs: Sequence[int]
) -> DataFrame:
    """Exact percentile table, one column per percent."""
    return quantiles(df, column, {f"p{q}": q / 100 for q in qs}, by)


def category_report(detections: DataFrame, category: str = "category") -> DataFrame:
    """Anomalous sessions per category: total, detected, missed, recall and lead of the detected."""
    anomalous = detections.filter("label = 1")
    lead = F.when(F.col("predicted") == 1, F.col("lead_min"))
    hit = anomalous.withColumn("_lead", lead)
    stats = hit.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("predicted") == 1).alias("detected"),
        F.count_if(F.col("predicted") == 0).alias("missed"),
        F.avg("_lead").alias("lead_mean"),
        F.min("_lead").alias("lead_min"),
        F.max("_lead").alias("lead_max"),
    )
    median = quantiles(hit, "_lead", {"lead_median": 0.5}, [category])
    return stats.join(median, category, "left").withColumn("recall", ratio(F.col("detected"), F.col("total")))


def fn_report(detections: DataFrame, category: str = "category", short: int = 2) -> DataFrame:
    """Missed anomalies per category: count, mean length, share with at most ``short`` rows."""
    missed = detections.filter("label = 1 and predicted = 0")
    return missed.groupBy(category).agg(
        F.count(F.lit(1)).alias("missed"),
        F.avg("n_events").alias("mean_events"),
        (100.0 * F.count_if(F.col("n_events") <= short) / F.count(F.lit(1))).alias("short_pct"),
    )


def fp_report(detections: DataFrame) -> DataFrame:
    """False alarms: count, loss range, mean, median and share of the normal sessions."""
    false = detections.filter("label = 0 and predicted = 1")
    stats = detections.filter("label = 0").agg(
        F.count_if(F.col("predicted") == 1).alias("n_fp"),
        F.min(F.when(F.col("predicted") == 1, F.col("alert_loss"))).alias("loss_min"),
        F.max(F.when(F.col("predicted") == 1, F.col("alert_loss"))).alias("loss_max"),
        F.avg(F.when(F.col("predicted") == 1, F.col("alert_loss"))).alias("loss_mean"),
        F.count(F.lit(1)).alias("n_normal"),
    )
    median = quantiles(false, "alert_loss", {"loss_median": 0.5}, [])  # one row
    out = stats.join(F.broadcast(median), F.lit(True), "left")
    return out.withColumn("pct_of_normal", 100.0 * ratio(F.col("n_fp"), F.col("n_normal")))


def top_alerts(detections: DataFrame, by: str, n: int = 20, descending: bool = True) -> DataFrame:
    """The ``n`` true positives with the highest (lowest) loss or lead."""
    hits = detections.filter(TRUE_POSITIVE).filter(F.col(by).isNotNull())
    return hits.orderBy(F.desc(by) if descending else F.asc(by), "session_id").limit(n)


def length_profile(sessions: DataFrame) -> DataFrame:
    """Five-number summary of session length per class."""
    names = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles(sessions, "n_events", names, ["label"])


def dataset_profile(events: DataFrame) -> DataFrame:
    """Rows, anomalous rows and share, sessions per class, distinct templates.

    Sessions and templates are each reduced to distinct keys before counting.
    """
    rows = events.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_anomalous_rows"),
    )
    sessions = (
        events.groupBy("session_id")
        .agg(F.max("label").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n_sessions"),
            F.count_if(F.col("label") == 1).alias("n_anomalous_sessions"),
        )
    )
    templates = events.select("event").distinct().agg(F.count("event").alias("n_templates"))
    out = rows.join(F.broadcast(sessions)).join(F.broadcast(templates))  # three single rows
    return out.withColumn("anomalous_pct", 100.0 * ratio(F.col("n_anomalous_rows"), F.col("n_rows")))


def compare_datasets(metrics: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """One row per metric with a column per dataset, the best dataset, and the ratio to the first."""
    long = []
    for dataset, df in metrics.items():
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
        )
        long.append(df.select(F.lit(dataset).alias("dataset"), F.explode(pairs).alias("p")).select("dataset", "p.*"))
    datasets = list(metrics)
    wide = reduce(DataFrame.unionByName, long).groupBy("metric").pivot("dataset", datasets).agg(F.max("value"))
    best = F.greatest(*datasets)
    winner = reduce(lambda rest, d: F.when(F.col(d) == best, F.lit(d)).otherwise(rest), reversed(datasets), F.lit(None))
    ratios = {f"{d}_ratio": ratio(F.col(d), F.col(datasets[0])) for d in datasets[1:]}
    return wide.withColumn("winner", winner).withColumns(ratios)


def category_timeline(events: DataFrame, category: Column, width: str = "1 hour") -> DataFrame:
    """Anomalous rows per time window and category."""
    return (
        events.filter("label = 1")
        .groupBy(F.window("ts", width).alias("w"), category.alias("category"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("window_start"), "category", "count")
    )


def escalation_order(timeline: DataFrame) -> DataFrame:
    """When each category first appears and when it peaks, earliest first."""
    peak = F.max(F.struct("count", (-F.unix_micros("window_start")).alias("back")))
    return (
        timeline.groupBy("category")
        .agg(F.min("window_start").alias("first_window"), F.sum("count").alias("count"), peak.alias("peak"))
        .select(
            "category",
            "first_window",
            "count",
            F.col("peak.count").alias("peak_count"),
            F.timestamp_micros(-F.col("peak.back")).alias("peak_window"),
        )
        .orderBy("first_window", "category")
    )


def verdicts(tests: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """One row per test from a one-row table: name, value, passed."""
    parts = [
        df.select(F.lit(name).alias("test"), value.cast("double").alias("value"), passed.alias("passed"))
        for name, (df, value, passed) in tests.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "verdict", F.when(F.col("passed"), "PASS").otherwise("FAIL")
    )


def alert_report(detections: DataFrame, description: Column, dictionary: DataFrame) -> DataFrame:
    """Alert detail per session, as stored with the results; ``dictionary`` has the template of each event."""
    named = with_template(with_template(detections, dictionary, "alert_event"), dictionary, "first_error_event")
    return named.select(
        "session_id",
        "label",
        "predicted",
        "first_anomaly_step",
        "n_events",
        short_desc(description, dots=False).alias("log_desc"),
        pattern_hash(description).alias("log_hash"),
        F.col("alert_event_template").alias("error_template"),
        F.col("first_error_event_template").alias("first_error_template"),
        "first_error_event",
        "first_error_ts",
        "first_error_pos",
        "alert_ts",
        F.col("lead_sec").alias("lead_time_seconds"),
        F.col("lead_min").alias("lead_time_minutes"),
        F.col("steps_before_error").alias("alert_step_before_error"),
        lead_class(F.col("lead_min")).alias("outcome"),
    )
