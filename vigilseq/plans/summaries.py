"""Queries over summaries that are stored per day and merged, and over live streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilseq.functions.text import categorize
from vigilseq.operators import leadtime, sessions, sketches
from vigilseq.plans import detection, logs, reports
from vigilseq.plans.catalog import PERCENTS
from vigilseq.plans.registry import query
from vigilseq.sources.staging import stage, staging_path
from vigilseq.streaming import first_alert, live_reports

FIVE = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
FREQUENT = 60


def _checked_quantiles(df, column, by, qs):
    """(*by, quantile, n, within): quantiles from merged sketches, and whether the exact rank is within twice the error."""
    stored = stage(sketches.quantile_sketches(df, column, [*by, "part"]), "sketches")
    found = sketches.sketch_quantiles(sketches.merge_quantile_sketches(stored, by), qs)
    each = F.array(*[F.struct(F.lit(n).alias("quantile"), F.lit(float(q)).alias("q"), F.col(n).alias("value")) for n, q in qs.items()])
    wanted = stage(found.select(*by, "n", F.explode(each).alias("e")).select(*by, "n", "e.*"), "quantiles")
    named = wanted.select(*[F.col(c).alias(f"_{c}") for c in by], "quantile", "q", "value", "n")
    same = F.lit(True)
    for c in by:
        same &= df[c].eqNullSafe(F.col(f"_{c}"))
    pairs = df.filter(F.col(column).isNotNull()).join(F.broadcast(named), same)  # as many rows as groups and quantiles
    ranks = pairs.groupBy(*by, "quantile", "q", "n").agg(
        (F.count_if(F.col(column) < F.col("value")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col(column) <= F.col("value")) / F.count(F.lit(1))).alias("up_to"),
    )
    error = 2 * sketches.rank_error()
    return ranks.select(*by, "quantile", "n", F.col("q").between(F.col("below") - error, F.col("up_to") + error).alias("within"))


def _day(ts):
    return F.floor(F.unix_micros(ts) / logs.MICROS_PER_DAY).alias("part")


@query("e17_sketch_percentiles")
def e17(spark, folder):
    losses = reports.scored_table(spark, folder).filter("loss is not null").select("label", "loss", _day("ts"))
    return _checked_quantiles(losses, "loss", ["label"], {f"p{p}": p / 100 for p in PERCENTS})


@query("e23_sketch_profile")
def e23(spark, folder):
    lengths = sessions.session_summary(logs.week_log(spark, folder)).select("label", "n_events", _day("start_ts"))
    return _checked_quantiles(lengths, "n_events", ["label"], FIVE)


@query("l15_sketch_five_number")
def l15(spark, folder):
    hits = reports.topk_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return _checked_quantiles(hits.select("category", "lead_min", _day("alert_ts")), "lead_min", ["category"], FIVE)


@query("v4_sketch_overlap")
def v4(spark, folder):
    """Overlap of normal and anomalous events from sketches per day and class."""
    rows = logs.week_log(spark, folder).select("label", "event", _day("ts"))
    stored = stage(sketches.distinct_sketches(rows, "event", ["label", "part"]), "sketches")
    found = sketches.sketch_overlap(stored, F.col("label") == 0, F.col("label") == 1)
    return found.withColumnsRenamed({"first_only": "normal_only", "second_only": "anomaly_only"})


@query("v6_sketch_diversity")
def v6(spark, folder):
    parts = [f(spark, folder).select("event", _day("ts"), F.lit(n).alias("dataset")) for n, f in (("day", logs.day_log), ("fine", logs.fine_log), ("orders", logs.order_log))]
    stored = stage(sketches.distinct_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]), "event", ["dataset", "part"]), "sketches")
    return sketches.distinct_counts(sketches.merge_distinct_sketches(stored, ["dataset"]))


@query("e24_sketch_profile")
def e24(spark, folder):
    """Distinct templates and sessions of the day log from sketches per day; the count of sessions is within four errors of the exact one."""
    log = logs.day_log(spark, folder).select("session_id", "event", _day("ts"))
    counts = {}
    for column in ("event", "session_id"):
        stored = stage(sketches.distinct_sketches(log, column, ["part"]), "sketches")
        counts[column] = sketches.distinct_counts(sketches.merge_distinct_sketches(stored, []))
    exact = log.select("session_id").distinct().agg(F.count(F.lit(1)).alias("n_sessions"))
    near = F.abs(F.col("n_distinct") - F.col("n_sessions")) <= F.col("n_sessions") * 4 / 2 ** (sketches.LG_ENTRIES / 2)
    found = counts["session_id"].join(F.broadcast(exact)).select("n_sessions", near.alias("within"))  # one row
    return found.join(F.broadcast(counts["event"].withColumnRenamed("n_distinct", "n_templates")))  # one row


@query("v5_frequent_summary")
def v5(spark, folder):
    """Bounds of the counts of frequent events from summaries per week."""
    week = F.floor(F.unix_micros("ts") / logs.MICROS_PER_WEEK).alias("week")
    log = logs.fine_log(spark, folder).select("event", week)
    stored = stage(sketches.frequent_summary(log, ["week"], FREQUENT), "summaries")
    return sketches.merge_summaries(stored, ["week"])


@query("g16_stream_gap_sessions")
def g16_stream(spark, folder):
    """The user log as a stream with late rows, its gap sessions written as they end."""
    path = staging_path(spark, "stream")
    stream, late = logs.live_files(spark, logs.user_log(spark, folder), f"{path}/in")
    live_reports.stream_gap_sessions(stream, "session_id", 6 * 3600, f"{path}/out", f"{late} seconds", **live_reports.NOW).awaitTermination()
    kind = stream.schema["session_id"].dataType.simpleString()
    return live_reports.read_gap_sessions(spark, f"{path}/out", "session_id", kind)


@query("e26_stream_timeline")
def e26_stream(spark, folder):
    """The day log as a stream with late rows, its category counts kept up per window."""
    path = staging_path(spark, "stream")
    stream, late = logs.live_files(spark, logs.day_log(spark, folder), f"{path}/in")
    category = categorize(F.col("event"), reports.CATEGORY_RULES)
    live_reports.stream_category_timeline(stream.filter("event <> 'end'"), category, f"{path}/out", f"{late} seconds", **live_reports.NOW).awaitTermination()
    return live_reports.read_category_timeline(spark, f"{path}/out")


@query("n12_reconciled_alerts")
def n12_reconciled(spark, folder):
    """First alerts of the week log whose late rows the stream drops, after sessions with late rows were scored again."""
    ngrams = detection.fit(detection.labelled_contexts(logs.week_log(spark, folder)))
    path = staging_path(spark, "stream")
    own = spark.newSession()
    own.conf.set(first_alert.PROVIDER, first_alert.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream, _ = logs.live_files(own, logs.week_log_with_end(own, folder), f"{path}/in")
    first_alert.stream_first_alert(stream, ngrams, reports.THRESHOLD, f"{path}/out", skip=reports.SKIP, watermark="1 hour", **live_reports.NOW).awaitTermination()
    log = logs.week_log_with_end(spark, folder)
    until = log.agg(F.max("session_end")).first()[0]
    return first_alert.reconciled_alerts(spark, f"{path}/out", log, until, ngrams, reports.THRESHOLD, skip=reports.SKIP)
