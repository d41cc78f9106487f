"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilseq import schema
from vigilseq.functions import numeric as num
from vigilseq.functions import text as txt
from vigilseq.operators import detect, evaluate, leadtime, model, rows, sessions, splits, stats, vocab
from vigilseq.plans import detection, logs, reports
from vigilseq.plans.registry import QUERIES, query  # noqa: F401
from vigilseq.sources import tables
from vigilseq.sources.staging import stage, staging_path
from vigilseq.streaming import first_alert

TRIALS = 1000
FILES, RANGE_BYTES = 6, 1 << 14  # of logs written to be read back: fewest files, and fewest bytes of a range
ROW_EVENTS = 65_536  # events of a session in one result row
PERCENTS = [25, 50, 75, 90, 95, 99]


def docs(spark, folder):
    return logs.table(spark, folder, "documents")


def timed(spark, folder):
    """Signed minutes derived from the events, with zeros and nulls."""
    minutes = (F.col("code") - 20) * F.col("value")
    return logs.coded_events(spark, folder).select(
        "event_id", F.when(F.col("code") != 99, minutes).alias("minutes")
    )


def positioned(log):
    return sessions.sessionize(log)


# -- sources and sinks --------------------------------------------------------


def _as_csv(spark, folder, ts):
    """The day log as a CSV file in the layout of the HDFS log."""
    path = staging_path(spark, "csv")
    logs.day_log(spark, folder).select(
        "session_id", ts.alias("timestamp"), F.col("event").alias("EventTemplate"), F.col("label").alias("anom_label")
    ).write.csv(path, header=True)
    return path


@query("s1_read_events_csv")
def s1(spark, folder):
    path = _as_csv(spark, folder, F.col("ts").cast("string"))
    out = tables.read_events(spark, path, schema.HDFS, "csv", schema.STRUCTS["hdfs"])
    return out.select("session_id", "ts", "event", "label")


@query("s1_read_openstack")
def s1_openstack(spark, folder):
    """All columns of the layout survive the read."""
    log = logs.coded_events(spark, folder)
    text = F.col("ts").cast("string")
    rows_ = log.select(
        F.col("user_id").alias("test_id"),
        text.alias("timestamp"),
        F.substring(text, 1, 13).alias("time_hour"),
        F.concat_ws(":", "event_type", "code").alias("EventId"),
        F.concat(F.lit("event <*>, \"kind\" "), F.col("event_type")).alias("EventTemplate"),
        F.concat_ws(" ", F.lit("code"), F.col("code").cast("string")).alias("Content"),
        F.concat(F.lit("svc"), (F.col("user_id") % 3).cast("string")).alias("service"),
        (F.col("event_type") == "error").cast("int").alias("anom_label"),
    )
    path = staging_path(spark, "openstack")
    rows_.write.options(header=True, quote='"', escape='"').csv(path)
    out = tables.read_events(spark, path, schema.OPENSTACK, "csv", schema.STRUCTS["openstack"])
    return out.drop("tiebreak")


def _files(log):
    """Number of files to write a log to: ``FILES``, and one more per ``logs.FILE_ROWS`` rows."""
    return FILES + log.count() // logs.FILE_ROWS


@query("s1_read_bgl")
def s1_bgl(spark, folder):
    """Times in whole seconds: rows of one second keep the order of several files, each read in several ranges."""
    log = logs.user_log(spark, folder)
    hour = F.expr("unix_micros(ts) div 3600000000") * 3600
    lines = log.select("session_id", hour.alias("timestamp"), "event", "label", "tiebreak")
    lines = lines.repartitionByRange(_files(log), "tiebreak").sortWithinPartitions("tiebreak")
    lines = lines.select(F.col("session_id").alias("node_id"), "timestamp", F.col("event").alias("EventTemplate"), "label")
    path = staging_path(spark, "bgl")
    lines.write.option("header", True).csv(path)
    out = tables.read_events_in_order(spark, path, schema.BGL, schema.STRUCTS["bgl"], split_bytes=RANGE_BYTES)
    return positioned(out).select("session_id", "pos", "ts", "event", "label")


@query("s2_read_columns_coerce_ts")
def s2(spark, folder):
    broken = F.when(F.col("tiebreak") % 10 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    path = _as_csv(spark, folder, broken)
    out = tables.read_events(spark, path, schema.HDFS, "csv", schema.STRUCTS["hdfs"])
    counted = [F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_ts"), F.max("ts").alias("last_ts")]
    return out.groupBy("session_id").agg(*counted)


def _flawed_lines(spark, folder):
    """The day log as lines of CSV in which some rows lack a field, a session, a time or a label."""
    key = F.col("tiebreak")
    time = F.when(key % 10 == 0, F.lit("not a time")).when(key % 11 == 0, F.lit("")).otherwise(F.col("ts").cast("string"))
    session = F.when(key % 13 == 0, F.lit("")).otherwise(F.col("session_id"))
    label = F.when(key % 17 == 0, F.lit("2")).when(key % 19 == 0, F.lit("")).when(key % 23 == 0, F.lit("x")).otherwise(F.col("label").cast("string"))
    more = F.when(key % 29 == 0, F.lit(",more")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", session, time, F.concat(F.lit('"'), F.col("event"), F.lit(', ""k"""')), label), more)
    path = staging_path(spark, "flawed")
    logs.day_log(spark, folder).select(line).write.text(path)
    return tables.read_checked(spark, path, schema.HDFS, schema.STRUCTS["hdfs"], header=False, split_bytes=RANGE_BYTES)


@query("s2_kept_rows")
def s2_kept(spark, folder):
    return tables.kept_rows(_flawed_lines(spark, folder)).drop("tiebreak")


@query("s2_rejected_rows")
def s2_rejected(spark, folder):
    """Rejected rows from the quarantine table, and how many there are of each reason."""
    path = staging_path(spark, "quarantine")
    tables.write_quarantine(_flawed_lines(spark, folder), path)
    found = tables.read_quarantine(spark, path)
    counts = found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(counts), "reason").select("reason", "line", "n")  # one row per reason


@query("s3_events_from_raw")
def s3(spark, folder):
    blocks = F.concat(F.lit("blk_"), F.col("session_id").cast("string"))
    labels = sessions.session_labels(logs.user_log(spark, folder)).select(blocks.alias("session_id"), "label")
    return tables.events_from_raw(logs.raw_lines(spark, folder), labels, r"blk_-?[0-9]+").drop("ts")


@query("s3_read_lines")
def s3_lines(spark, folder):
    """Two sets of files of raw lines with times in whole hours, and a label file, read back in line order."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    raw = logs.raw_lines(spark, folder).withColumn("text", F.concat_ws(" ", hour, "line"))
    block = F.regexp_extract("line", "blk_([0-9]+)", 1).cast("bigint")
    path, files = staging_path(spark, "lines"), _files(raw)
    for part in range(2):
        own = raw.filter(block % 2 == part).repartitionByRange(files, "tiebreak").sortWithinPartitions("tiebreak")
        own.select("text").write.text(f"{path}/half-{part}")
    blocks = F.concat(F.lit("blk_"), F.col("session_id").cast("string")).alias("BlockId")
    truth = F.when(F.col("label") == 1, "Anomaly").otherwise("Normal").alias("Label")
    sessions.session_labels(logs.user_log(spark, folder)).select(blocks, truth).write.option("header", True).csv(f"{path}-labels")
    lines = tables.read_ordered_lines(spark, path, r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "yyyy-MM-dd HH:mm:ss", RANGE_BYTES)
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\S+ \S+ ", ""))
    labels = tables.read_labels(spark, f"{path}-labels", "BlockId", "Label")
    log = tables.events_from_raw(lines, labels, r"blk_-?[0-9]+")
    return positioned(log).select("session_id", "pos", "ts", "event", "label", "template")


@query("s3_event_dictionary")
def s3_dictionary(spark, folder):
    """First errors of the raw log with their template, by the event's id."""
    blocks = F.concat(F.lit("blk_"), F.col("session_id").cast("string"))
    labels = sessions.session_labels(logs.user_log(spark, folder)).select(blocks.alias("session_id"), "label")
    log = tables.events_from_raw(logs.raw_lines(spark, folder), labels, r"blk_-?[0-9]+")
    first = sessions.first_error(sessions.with_position(log.drop("template")))
    return vocab.with_template(first.drop("first_error_ts"), vocab.event_dictionary(log), "first_error_event")


@query("s4_detections_round_trip")
def s4(spark, folder):
    found = reports.threshold_table(spark, folder)
    records = tables.result_records(found, txt.short_desc(F.col("last_event")))
    path = staging_path(spark, "results")
    tables.write_detections(records, evaluate.class_metrics(evaluate.confusion(found)), path)
    stored, header = tables.read_results(spark, path)
    return stored.join(F.broadcast(header.select("tp", "fp", "f1")))  # one row


@query("s5_load_threshold")
def s5(spark, folder):
    normal = model.session_loss(reports.scored_table(spark, folder)).filter("label = 0")
    path = staging_path(spark, "tuned")
    tables.save_threshold(evaluate.ksigma_threshold(normal, 2.0), path)
    tuned = tables.load_threshold(spark, path).select(F.lit("tuned").alias("source"), "threshold")
    absent = tables.load_threshold(spark, f"{path}-absent").select(F.lit("default").alias("source"), "threshold")
    return tuned.unionByName(absent)


@query("s6_vocab_round_trip")
def s6(spark, folder):
    path = staging_path(spark, "vocab")
    tables.save_vocab(vocab.with_special(vocab.fit_vocab(logs.day_log(spark, folder))), path)
    return tables.load_vocab(spark, path)


@query("s7_report_table")
def s7(spark, folder):
    path = staging_path(spark, "report")
    tables.write_table(leadtime.lead_by_pattern(reports.topk_table(spark, folder)), path)
    return spark.read.parquet(path)


# -- rows and scalar functions ------------------------------------------------


@query("p1_normal_rows")
def p1(spark, folder):
    return rows.normal_rows(logs.gappy_log(spark, folder)).select("session_id", "tiebreak", "event")


@query("p2_filter_label")
def p2(spark, folder):
    log = logs.gappy_log(spark, folder)
    anomalous = rows.filter_label(log, 1).select("tiebreak", "event", F.lit("1").alias("kept"))
    return anomalous.unionByName(rows.filter_label(log).select("tiebreak", "event", F.lit("all").alias("kept")))


@query("p3_null_event")
def p3(spark, folder):
    event = F.col("event")
    return logs.gappy_log(spark, folder).select(
        "tiebreak", txt.null_event(event).alias("scored_as"), txt.null_event(event, vocab.UNK).alias("encoded_as")
    )


@query("p4_epoch_ts")
def p4(spark, folder):
    seconds = F.floor(F.unix_micros("ts") / 1_000_000)
    return logs.coded_events(spark, folder).select("event_id", num.epoch_ts(seconds).alias("ts"))


@query("p5_short_desc")
def p5(spark, folder):
    text = F.col("text")
    return docs(spark, folder).select(
        "doc_id", txt.short_desc(text).alias("dotted"), txt.short_desc(text, dots=False).alias("plain")
    )


@query("p6_pattern_hash")
def p6(spark, folder):
    return docs(spark, folder).select("doc_id", txt.pattern_hash(F.col("text")).alias("log_hash"))


@query("p7_short_label_os")
def p7(spark, folder):
    raw, kind = F.col("text"), F.col("doc_id") % 6
    raw = (
        F.when(kind == 0, raw)
        .when(kind == 1, F.concat(F.lit(' "Failure of '), raw))
        .when(kind == 2, F.concat(raw, F.lit(" Traceback (most recent call last): "), raw))
        .when(kind == 3, F.concat(F.lit('"nova: '), F.translate(raw, "\n", " "), F.lit(" None None None File")))
        .when(kind == 4, F.concat("lang", F.lit(" None File "), raw))
    )
    return docs(spark, folder).select("doc_id", txt.short_label_os(raw).alias("short"))


@query("p8_short_label_hdfs")
def p8(spark, folder):
    raw = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" \t"), F.col("text"), F.lit("\n")))
    return docs(spark, folder).select("doc_id", txt.short_label_hdfs(raw).alias("short"))


@query("p9_duration_text")
def p9(spark, folder):
    return timed(spark, folder).select("event_id", num.duration_text(F.col("minutes")).alias("duration"))


@query("p10_band_openstack")
def p10(spark, folder):
    return timed(spark, folder).select("event_id", num.band(F.col("minutes")).alias("band"))


@query("p11_band_hdfs")
def p11(spark, folder):
    band = num.band(F.col("minutes"), num.HDFS_CUTS, num.HDFS_BANDS)
    return timed(spark, folder).select("event_id", band.alias("band"))


@query("p12_bucketize")
def p12(spark, folder):
    minutes = F.col("minutes")
    return timed(spark, folder).select(
        "event_id",
        num.bucketize(minutes, num.LEAD_EDGES).alias("bin"),
        num.bucketize(minutes, num.SHORT_LEAD_EDGES).alias("short_bin"),
    )


@query("p13_mask_template")
def p13(spark, folder):
    page = logs.table(spark, folder, "pages").select("page_id", txt.mask_template(F.col("html")).alias("template"))
    return page.select("page_id", F.md5("template").alias("digest"), F.length("template").alias("n_chars"))


@query("p14_event_id")
def p14(spark, folder):
    template = txt.mask_template(F.col("line"))
    lines = logs.raw_lines(spark, folder).select(template.alias("template"))
    return lines.groupBy("template").agg(F.count(F.lit(1)).alias("cnt")).withColumn(
        "event_id", txt.event_id(F.col("template"))
    )


@query("p15_categorize")
def p15(spark, folder):
    html = F.col("html")
    return logs.table(spark, folder, "pages").select(
        "page_id",
        txt.categorize(html, txt.BGL_RULES).alias("bgl"),
        txt.categorize(html, txt.HDFS_RULES).alias("hdfs"),
        txt.categorize(html, txt.OPENSTACK_RULES).alias("openstack"),
    )


@query("p16_perplexity")
def p16(spark, folder):
    value = num.perplexity(F.col("value") / 8)
    finite = value < float("inf")
    return logs.coded_events(spark, folder).select(
        "event_id", F.round(F.when(finite, value), 3).alias("perplexity"), (~finite).alias("unbounded")
    )


@query("p17_position_pct")
def p17(spark, folder):
    pct = num.position_pct(F.col("pos") + 1, F.col("n_events"))
    return positioned(logs.day_log(spark, folder)).select("session_id", "pos", pct.alias("pct"))


@query("p18_event_count")
def p18(spark, folder):
    return sessions.session_lengths(logs.day_log(spark, folder))


# -- sessions and windows -----------------------------------------------------


@query("g1_with_position")
def g1(spark, folder):
    return sessions.with_position(logs.user_log(spark, folder)).select("session_id", "tiebreak", "pos")


@query("g2_session_sequences")
def g2(spark, folder):
    return sessions.session_sequences(sessions.with_position(logs.day_log(spark, folder)), max_events=ROW_EVENTS)


@query("g3_session_labels")
def g3(spark, folder):
    return sessions.session_labels(logs.week_log(spark, folder))


@query("g4_joined_text")
def g4(spark, folder):
    return sessions.session_sequences(sessions.with_position(logs.talk_log(spark, folder)), " \n ", max_events=ROW_EVENTS)


@query("g4_session_head")
def g4_head(spark, folder):
    return sessions.session_head(sessions.with_position(logs.user_log(spark, folder)))


@query("g5_session_summary")
def g5(spark, folder):
    return sessions.session_summary(logs.week_log(spark, folder))


@query("g6_first_error")
def g6(spark, folder):
    return sessions.first_error(sessions.with_position(logs.week_log(spark, folder)))


@query("g7_split_long")
def g7(spark, folder):
    cut = sessions.split_long(sessions.with_position(logs.user_log(spark, folder)), 25)
    return cut.select("session_id", "tiebreak", "chunk_no", "chunk_pos")


def _windows(spark, folder):
    return sessions.window_table(
        sessions.count_windows(sessions.with_position(logs.user_log(spark, folder)), 20)
    )


@query("g8_count_windows")
def g8(spark, folder):
    return _windows(spark, folder)


@query("g9_sliding_windows")
def g9(spark, folder):
    return sessions.sliding_windows(sessions.with_position(logs.user_log(spark, folder)), 20, 5)


@query("g10_clean_windows")
def g10(spark, folder):
    return sessions.clean_windows(_windows(spark, folder)).select("session_id", "window_no", "n_events")


def _tokens(spark, folder):
    log = logs.day_log(spark, folder)
    return vocab.encode(positioned(log), vocab.fit_vocab(log))


@query("g11_pack_blocks")
def g11(spark, folder):
    tokens = stage(_tokens(spark, folder), "tokens")  # read for the lengths and for the blocks
    return sessions.pack_blocks(tokens, 16, 8)


@query("g12_head_events")
def g12(spark, folder):
    head = sessions.head_events(sessions.with_position(logs.user_log(spark, folder)), 10)
    return head.select("session_id", "pos", "event")


@query("g13_with_context")
def g13(spark, folder):
    out = sessions.with_context(sessions.with_position(logs.user_log(spark, folder)), 3)
    return out.select("session_id", "pos", "event", "context")


@query("g14_order_check")
def g14(spark, folder):
    return sessions.order_check(logs.order_log(spark, folder), "tiebreak")


@query("g15_event_counts")
def g15(spark, folder):
    return sessions.event_counts(logs.day_log(spark, folder))


@query("g15_event_counts_wide")
def g15_wide(spark, folder):
    return sessions.event_counts(logs.talk_log(spark, folder), ["user", "assistant", "system"])


@query("g16_gap_sessions")
def g16(spark, folder):
    return sessions.gap_sessions(logs.user_log(spark, folder), "session_id", 6 * 3600)


# -- vocabulary ---------------------------------------------------------------


@query("v1_fit_vocab")
def v1(spark, folder):
    return vocab.with_special(vocab.fit_vocab(logs.gappy_log(spark, folder)))


@query("v2_encode")
def v2(spark, folder):
    log = logs.day_log(spark, folder)
    return vocab.encode(positioned(log), vocab.fit_vocab(log), add_sep=True)


@query("v3_decode")
def v3(spark, folder):
    known = vocab.fit_vocab(logs.day_log(spark, folder))
    return vocab.decode(_tokens(spark, folder), known).select("session_id", "pos", "event")


@query("v4_vocab_overlap")
def v4(spark, folder):
    return vocab.vocab_overlap(logs.week_log(spark, folder))


@query("v5_event_frequency")
def v5(spark, folder):
    log = logs.week_log(spark, folder)
    rare = vocab.event_frequency(log, 300).select("event", F.lit(1).alias("rare"))
    return vocab.event_frequency(log).join(rare, "event", "left")


@query("v6_event_diversity")
def v6(spark, folder):
    named = {"day": logs.day_log, "talk": logs.talk_log, "orders": logs.order_log}
    parts = [vocab.event_diversity(f(spark, folder)).withColumn("dataset", F.lit(n)) for n, f in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- splits -------------------------------------------------------------------


def _week_sessions(spark, folder):
    return sessions.session_summary(logs.week_log(spark, folder))


@query("m1_split_normal")
def m1(spark, folder):
    return splits.split_normal(_week_sessions(spark, folder))


@query("m2_split_two")
def m2(spark, folder):
    return splits.split_two(_week_sessions(spark, folder))


@query("m3_split_windows")
def m3(spark, folder):
    return splits.split_windows(_windows(spark, folder))


@query("m4_test_set")
def m4(spark, folder):
    log = logs.week_log(spark, folder)
    named = splits.split_normal(sessions.session_labels(log))
    return splits.test_set(log, named).select("session_id", "tiebreak")


@query("m5_split_by_time")
def m5(spark, folder):
    return splits.split_by_time(_week_sessions(spark, folder), "2024-01-22 00:00:00")


@query("m5_split_by_share")
def m5_share(spark, folder):
    return splits.split_by_share(_week_sessions(spark, folder), 0.8)


@query("m6_leakage_audit")
def m6(spark, folder):
    every = _week_sessions(spark, folder)
    twice = splits.split_normal(every).unionByName(splits.split_normal(every, seed="7"))
    return splits.leakage_audit(twice)


# -- next-event model and detection -------------------------------------------


@query("n1_fit_next_event")
def n1(spark, folder):
    contexts = detection.labelled_contexts(logs.week_log(spark, folder), 2)
    return model.fit_next_event(detection.train_rows(contexts), 2)


@query("n1_fit_row_scope")
def n1_rows(spark, folder):
    contexts = detection.labelled_contexts(logs.week_log(spark, folder))
    return detection.fit(contexts, normal_scope="row").select("order", "ctx", "next", "cnt", "ctx_cnt")


@query("n2_topk_next")
def n2(spark, folder):
    contexts = detection.labelled_contexts(logs.day_log(spark, folder))
    return model.topk_next(detection.fit(contexts).drop("rank"), 5)


@query("n3_topk_miss")
def n3(spark, folder):
    contexts = detection.stored_contexts(logs.day_log(spark, folder))
    scored = model.score_events(contexts.filter("split = 'test'"), detection.fit(contexts), k=reports.TOP_K)
    return detect.topk_miss(scored).select("session_id", "pos", "ts", "event")


@query("n4_event_loss")
def n4(spark, folder):
    return reports.scored_table(spark, folder).select("session_id", "pos", "split", "loss", "in_topk")


@query("n4_event_loss_backoff")
def n4_backoff(spark, folder):
    contexts = detection.stored_contexts(logs.week_log(spark, folder), 2)
    scored = model.score_events(contexts, detection.fit(contexts, 2), 2, k=5, skip=1, min_ctx=20)
    return scored.select("session_id", "pos", "loss", "in_topk")


@query("n5_session_loss")
def n5(spark, folder):
    return model.session_loss(reports.scored_table(spark, folder))


@query("n6_detect_topk")
def n6(spark, folder):
    names = ["session_id", "label", "predicted", "first_anomaly_step", "alert_pos", "alert_ts", "alert_event", "n_events"]
    found = detection.topk_detections(logs.day_log(spark, folder), 1, reports.TOP_K)
    return found.select(*names)


@query("n6_detect_topk_large_k")
def n6_large(spark, folder):
    found = detection.topk_detections(logs.fine_log(spark, folder), 1, 60)
    return found.select("session_id", "label", "predicted", "first_anomaly_step", "alert_pos", "alert_event")


@query("n7_detect_threshold")
def n7(spark, folder):
    found = detection.threshold_detections(logs.week_log(spark, folder), reports.THRESHOLD, 1, reports.SKIP)
    return found.select("session_id", "label", "predicted", "alert_pos", "alert_ts", "alert_loss", "max_loss", "last_event")


@query("n8_detect_avg_loss")
def n8(spark, folder):
    return detect.detect_avg_loss(model.session_loss(reports.scored_table(spark, folder)), 2.8)


@query("n9_model_perplexity")
def n9(spark, folder):
    return model.model_perplexity(reports.scored_table(spark, folder).filter("split = 'val'"))


@query("n10_unseen_event_alert")
def n10(spark, folder):
    log = logs.day_log(spark, folder)
    return detect.unseen_event_alert(log, vocab.fit_vocab(log))


@query("n11_hybrid_detect")
def n11(spark, folder):
    log = logs.day_log(spark, folder)
    rare = vocab.event_frequency(log, 130)
    return detect.hybrid_detect(reports.topk_table(spark, folder), log, rare, [("^error:[01]$", "error")])


@query("n12_stream_first_alert")
def n12(spark, folder):
    """The week log as a stream of time-ordered files, one per micro-batch, in a session with its own state store."""
    contexts = detection.labelled_contexts(logs.week_log(spark, folder))
    ngrams = detection.fit(contexts)
    path = staging_path(spark, "stream")
    own = spark.newSession()
    own.conf.set(first_alert.PROVIDER, first_alert.ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    running = first_alert.stream_first_alert(
        logs.week_files(own, folder, f"{path}/in"), ngrams, reports.THRESHOLD, f"{path}/out", skip=reports.SKIP, availableNow=True
    )
    running.awaitTermination()
    return first_alert.read_first_alerts(spark, f"{path}/out")


# -- lead time ----------------------------------------------------------------


@query("n6_detect_topk_windows")
def n6_windows(spark, folder):
    cut = sessions.count_windows(sessions.with_position(logs.user_log(spark, folder)), 20)
    found = detection.topk_detections(sessions.windows_as_sessions(cut), 1, 17)
    return found.select("session_id", "label", "predicted", "alert_pos", "first_error_pos", "steps_before_error")


@query("n7_detect_ksigma")
def n7_ksigma(spark, folder):
    found = detection.ksigma_detections(logs.week_log(spark, folder), 1.0)
    return found.select("session_id", "label", "predicted", "alert_pos", "alert_loss", "lead_min")


@query("n7_detect_stored_threshold")
def n7_stored(spark, folder):
    """Calibrated on labelled sessions that are held out, stored, read back and used."""
    contexts = detection.stored_contexts(logs.week_log(spark, folder))
    ngrams = detection.fit(contexts)
    best = evaluate.calibrate(_calibration(spark, folder), "score", "label", reports.GRID)
    path = staging_path(spark, "threshold")
    tables.save_threshold(best.select("threshold"), path)
    found = detection.stored_threshold_detections(contexts, ngrams, tables.load_threshold(spark, path), reports.SKIP)
    return found.select("session_id", "label", "predicted", "alert_pos", "alert_loss")


@query("n7_unscorable")
def n7_unscorable(spark, folder):
    return detect.unscorable(reports.threshold_table(spark, folder), reports.SKIP)


def _with_head(spark, folder):
    """Top-K detections with the start of the session's text, which describes an alert."""
    heads = sessions.session_head(sessions.with_position(logs.day_log(spark, folder)))
    return reports.topk_table(spark, folder).join(heads, "session_id", "left")


@query("l1_lead_to_end")
def l1(spark, folder):
    found = reports.threshold_table(spark, folder).drop("lead_min")
    return leadtime.lead_to_end(found).select("session_id", "predicted", "lead_min")


@query("l2_lead_to_first_error")
def l2(spark, folder):
    found = reports.topk_table(spark, folder).drop("lead_min", "lead_sec")
    return leadtime.lead_to_first_error(found).select("session_id", "alert_ts", "first_error_ts", "lead_min", "lead_sec")


@query("l3_steps_before_error")
def l3(spark, folder):
    found = reports.topk_table(spark, folder).drop("steps_before_error")
    return leadtime.steps_before_error(found).select("session_id", "steps_before_error")


@query("l4_lead_interpolated")
def l4(spark, folder):
    out = leadtime.lead_or_estimate(reports.topk_table(spark, folder))
    return out.select("session_id", "lead_est_min", "lead_used_min")


@query("l5_lead_outcome")
def l5(spark, folder):
    return leadtime.lead_outcome(reports.topk_table(spark, folder))


@query("l6_lead_stats")
def l6(spark, folder):
    found = reports.threshold_table(spark, folder)
    early = leadtime.lead_stats(found, positive_only=True).withColumn("over", F.lit("positive"))
    return leadtime.lead_stats(found).withColumn("over", F.lit("all")).unionByName(early)


@query("l7_lead_by_category")
def l7(spark, folder):
    return leadtime.lead_by_category(reports.topk_table(spark, folder))


@query("l8_lead_by_event")
def l8(spark, folder):
    return leadtime.lead_by_event(reports.topk_table(spark, folder))


@query("l9_lead_by_signature")
def l9(spark, folder):
    return leadtime.lead_by_signature(reports.threshold_table(spark, folder), txt.short_desc(F.col("last_event")))


@query("l10_failure_diversity")
def l10(spark, folder):
    return leadtime.failure_diversity(_with_head(spark, folder), F.col("head"))


@query("l11_best_and_worst_leads")
def l11(spark, folder):
    found = reports.topk_table(spark, folder)
    best = leadtime.best_leads(found).select("session_id", "lead_min", F.lit("best").alias("kind"))
    return best.unionByName(leadtime.worst_leads(found).select("session_id", "lead_min", F.lit("worst").alias("kind")))


@query("l12_lead_bands")
def l12(spark, folder):
    return leadtime.lead_bands(reports.topk_table(spark, folder))


@query("l12_lead_bins")
def l12_bins(spark, folder):
    return leadtime.lead_bins(reports.threshold_table(spark, folder), num.LEAD_EDGES)


@query("l13_lead_histogram")
def l13(spark, folder):
    hits = reports.topk_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return leadtime.histogram(hits, "lead_min", 50, (0.01, 0.99))


@query("l13_lead_histogram_zoom")
def l13_zoom(spark, folder):
    hits = reports.topk_table(spark, folder).filter(leadtime.TRUE_POSITIVE).filter("lead_min <= 60")
    return leadtime.histogram(hits, "lead_min", 30)


@query("l14_lead_ecdf")
def l14(spark, folder):
    hits = reports.threshold_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return leadtime.ecdf(hits, "lead_min")


@query("l15_five_number")
def l15(spark, folder):
    hits = reports.topk_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return leadtime.five_number(hits, "lead_min", "category", 3)


@query("l16_detection_vs_error")
def l16(spark, folder):
    return leadtime.detection_vs_error(reports.topk_table(spark, folder))


@query("l17_loss_vs_lead")
def l17(spark, folder):
    return leadtime.loss_vs_lead(reports.threshold_table(spark, folder))


@query("l18_value_frequency")
def l18(spark, folder):
    hits = reports.threshold_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return leadtime.value_frequency(hits, "lead_min")


@query("l18_steps_frequency")
def l18_steps(spark, folder):
    hits = reports.topk_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return leadtime.value_frequency(hits, "steps_before_error")


@query("l19_lead_by_pattern")
def l19(spark, folder):
    return leadtime.lead_by_pattern(reports.topk_table(spark, folder))


# -- evaluation and statistics ------------------------------------------------


def _scores(spark, folder):
    """Score and truth per week session: the highest loss, 0 where nothing was scored."""
    return reports.threshold_table(spark, folder).select(
        "session_id", "label", "predicted", F.coalesce("max_loss", F.lit(0.0)).alias("score")
    )


def _losses(spark, folder):
    return model.session_loss(reports.scored_table(spark, folder))


@query("e1_confusion")
def e1(spark, folder):
    return evaluate.confusion(reports.topk_table(spark, folder))


@query("e2_class_metrics")
def e2(spark, folder):
    return evaluate.class_metrics(evaluate.confusion(reports.threshold_table(spark, folder)))


@query("e3_ksigma_threshold")
def e3(spark, folder):
    return evaluate.ksigma_threshold(_losses(spark, folder).filter("label = 0"), 8.0)


@query("e4_class_separation")
def e4(spark, folder):
    return evaluate.class_separation(_losses(spark, folder))


@query("e5_threshold_sweep")
def e5(spark, folder):
    return evaluate.threshold_sweep(_scores(spark, folder), "score", "label", reports.GRID)


@query("e5_threshold_sweep_censored")
def e5_censored(spark, folder):
    """The published sweep: the loss at the first alert, 0 without one."""
    found = reports.threshold_table(spark, folder)
    return evaluate.threshold_sweep(found, "alert_loss", "label", evaluate.COARSE_GRID)


def _calibration(spark, folder):
    """Highest loss per session of the calibration set: validation sessions and held-out anomalous ones."""
    scored = reports.scored_table(spark, folder).withColumn("label", F.col("session_label"))
    held = splits.calibration_set(scored.filter("split <> 'train'"))
    return model.session_loss(held).select("session_id", "label", F.coalesce("max_loss", F.lit(0.0)).alias("score"))


@query("e6_calibrate")
def e6(spark, folder):
    return evaluate.calibrate(_calibration(spark, folder), "score", "label", reports.GRID)


@query("e6_calibrate_k")
def e6_k(spark, folder):
    ks = [k / 10 for k in range(0, 31)]
    return evaluate.calibrate_k(_scores(spark, folder), "score", "label", ks)


@query("e7_robust_range")
def e7(spark, folder):
    sweep = evaluate.threshold_sweep(_scores(spark, folder), "score", "label", reports.GRID)
    return evaluate.robust_range(sweep)


@query("e8_random_baseline")
def e8(spark, folder):
    return stats.random_baseline(reports.topk_table(spark, folder), TRIALS)


@query("e9_permutation_test")
def e9(spark, folder):
    return stats.permutation_test(reports.topk_table(spark, folder), TRIALS)


@query("e10_trivial_baselines")
def e10(spark, folder):
    return evaluate.trivial_baselines(reports.topk_table(spark, folder))


@query("e11_rank_test")
def e11(spark, folder):
    return stats.rank_test(_scores(spark, folder), "score", "label").drop("tie_term")


@query("e11_rank_test_documents")
def e11_docs(spark, folder):
    truth = logs.table(spark, folder, "labels")
    scored = docs(spark, folder).join(truth, "doc_id").select(F.col("n_chars").cast("double").alias("score"), "toxic")
    return stats.rank_test(scored, "score", "toxic").drop("tie_term")


@query("e12_welch")
def e12(spark, folder):
    return stats.welch(_scores(spark, folder), "score", "label")


@query("e13_ks")
def e13(spark, folder):
    return stats.ks(_scores(spark, folder), "score", "label")


@query("e14_cohens_d")
def e14(spark, folder):
    return stats.cohens_d(_scores(spark, folder), "score", "label")


@query("e15_pr_curve")
def e15(spark, folder):
    return stats.pr_curve(_scores(spark, folder), "score", "label")


@query("e15_auprc")
def e15_area(spark, folder):
    return stats.auprc(_scores(spark, folder), "score", "label")


@query("e16_roc_curve")
def e16(spark, folder):
    return stats.roc_curve(_scores(spark, folder), "score", "label")


@query("e16_roc_auc")
def e16_area(spark, folder):
    area = stats.roc_auc(_scores(spark, folder), "score", "label")
    mean = stats.average_precision(_scores(spark, folder), "score", "label")
    return area.join(F.broadcast(mean))  # two single rows


@query("e17_percentiles")
def e17(spark, folder):
    return evaluate.percentiles(_scores(spark, folder), "score", ["label"], PERCENTS)


@query("e17_alert_loss_percentiles")
def e17_alerts(spark, folder):
    hits = reports.threshold_table(spark, folder).filter(leadtime.TRUE_POSITIVE)
    return evaluate.percentiles(hits, "alert_loss", [], [10, *PERCENTS])


@query("e18_alert_loss_histogram")
def e18_alerts(spark, folder):
    flagged = reports.threshold_table(spark, folder).filter("predicted = 1")
    return leadtime.histogram(flagged, "alert_loss", 50, by="label")


@query("e18_loss_histogram")
def e18(spark, folder):
    positive = _scores(spark, folder).filter("score > 0")
    return leadtime.histogram(positive, "score", 100, by="label")


@query("e19_category_report")
def e19(spark, folder):
    return evaluate.category_report(reports.topk_table(spark, folder))


@query("e20_fn_report")
def e20(spark, folder):
    return evaluate.fn_report(reports.topk_table(spark, folder))


@query("e21_fp_report")
def e21(spark, folder):
    return evaluate.fp_report(reports.threshold_table(spark, folder))


@query("e22_top_alerts")
def e22(spark, folder):
    found = reports.threshold_table(spark, folder)
    early = found.filter("lead_min > 0")
    names = ["session_id", "alert_loss", "lead_min", "category", "n_events"]
    highest = evaluate.top_alerts(found, "alert_loss").select(F.lit("highest_loss").alias("kind"), *names)
    quickest = evaluate.top_alerts(early, "lead_min", descending=False).select(F.lit("quickest").alias("kind"), *names)
    earliest = evaluate.top_alerts(early, "lead_min").select(F.lit("earliest").alias("kind"), *names)
    return highest.unionByName(quickest).unionByName(earliest)


@query("e23_length_profile")
def e23(spark, folder):
    return evaluate.length_profile(_week_sessions(spark, folder))


@query("e24_dataset_profile")
def e24(spark, folder):
    return evaluate.dataset_profile(logs.day_log(spark, folder))


def _metrics(found):
    return evaluate.class_metrics(evaluate.confusion(found))


@query("e25_compare_datasets")
def e25(spark, folder):
    found = {"day": _metrics(reports.topk_table(spark, folder)), "week": _metrics(reports.threshold_table(spark, folder))}
    return evaluate.compare_datasets(found, ["precision", "recall", "f1", "accuracy", "specificity"])


@query("e26_category_timeline")
def e26(spark, folder):
    category = txt.categorize(F.col("event"), reports.CATEGORY_RULES)
    return evaluate.category_timeline(logs.day_log(spark, folder), category)


@query("e26_escalation_order")
def e26_order(spark, folder):
    category = txt.categorize(F.col("event"), reports.CATEGORY_RULES)
    return evaluate.escalation_order(evaluate.category_timeline(logs.day_log(spark, folder), category, "1 day"))


@query("e27_verdicts")
def e27(spark, folder):
    scores = stage(_scores(spark, folder), "scores")
    rank = stats.rank_test(scores, "score", "label")
    robust = evaluate.robust_range(evaluate.threshold_sweep(scores, "score", "label", reports.GRID))
    return evaluate.verdicts(
        {
            "random baseline": (stats.random_baseline(scores, 100), F.col("random_f1_mean"), F.col("passed")),
            "label permutation": (stats.permutation_test(scores, 100), F.col("p_value"), F.col("passed")),
            "threshold sensitivity": (robust, F.col("width"), F.col("passed")),
            "trivial baselines": (evaluate.trivial_baselines(scores), F.col("improvement"), F.col("passed")),
            "effect size": (stats.cohens_d(scores, "score", "label"), F.col("d"), F.abs("d") > 0.5),
            "separation": (rank, F.col("auroc"), F.col("auroc") > 0.8),
        }
    )


@query("e28_alert_report")
def e28(spark, folder):
    template = F.concat(F.lit("event "), F.split("event", ":")[0])
    known = vocab.event_dictionary(logs.day_log(spark, folder).withColumn("template", template))
    return evaluate.alert_report(_with_head(spark, folder), F.col("head"), stage(known, "dictionary"))


@query("first_alerts_with_lead")
def flagship(spark, folder):
    """Day log to detected sessions with their lead time."""
    found = detection.topk_detections(logs.day_log(spark, folder), 1, reports.TOP_K)
    names = ["session_id", "alert_pos", "alert_ts", "alert_event", "first_error_ts", "first_error_event", "lead_min"]
    return found.filter(leadtime.TRUE_POSITIVE).select(*names)
