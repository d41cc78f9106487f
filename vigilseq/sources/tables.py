"""Reading logs, labels and results; writing results."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseq.functions.text import MASK_RULES, event_id, mask_template
from vigilseq.operators.templates import match_templates
from vigilseq.schema import LogSchema, canonical
from vigilseq.sources.log_files import SPLIT_BYTES, ordered_lines

CORRUPT = "_corrupt"
DEFAULT_THRESHOLD = 5.0  # fixed value of the reference, used when no tuned one exists

RESULT_FIELDS = "session_id string, label int, is_detected boolean, lead_time_minutes double, alert_loss double, final_log string"
TOPK_HEADER = (
    "detection_method string, precision double, recall double, f1_score double, accuracy double, "
    "tp bigint, fp bigint, tn bigint, fn bigint"
)
TOPK_FIELDS = (
    "test_id: string, label: int, predicted: int, first_anomaly_step: int, n_events: int, log_desc: string, "
    "log_hash: string, error_template: string, first_error_template: string, first_error_timestamp: string, "
    "first_error_index: int, first_error_eventid: string, alert_timestamp: string, lead_time_seconds: double, "
    "lead_time_minutes: double, alert_step_before_error: int"
)
RESULT_FILE = (
    "metrics struct<precision: double, recall: double, f1: double, accuracy: double, confusion_matrix: array<array<bigint>>>, "
    "threshold double, results array<struct<session_id: string, label: int, is_detected: boolean, "
    "lead_time_minutes: double, alert_loss: double, final_log: string>>"
)


def read_events(
    spark: SparkSession,
    path: str,
    schema: LogSchema,
    fmt: str = "parquet",
    struct: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Event table from parquet or from CSV with header; only the columns of the schema are read.

    ``multi_line`` is for CSV whose quoted texts hold line breaks; such a file is
    read by one task, so split it or convert it to parquet when it is large.
    """
    reader = spark.read
    if struct is not None:
        reader = reader.schema(struct)
    if fmt == "csv":
        if struct is None:
            raise ValueError("a CSV log needs its column types")
        reader = reader.options(header=True, multiLine=multi_line, quote='"', escape='"')
    return canonical(reader.format(fmt).load(path), schema)


def read_events_in_order(
    spark: SparkSession,
    path: str,
    schema: LogSchema,
    struct: T.StructType,
    header: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Event table from CSV files whose rows of equal time keep the order of files and lines.

    Files are read in ranges of bytes, so a row must not hold line breaks.  With ``header``
    the first line of every file is left out.
    """
    return canonical(_csv_lines(spark, path, struct, header, split_bytes).select("tiebreak", "row.*"), replace(schema, tiebreak="tiebreak"))


def _csv_lines(spark: SparkSession, path: str, struct: T.StructType, header: bool, split_bytes: int) -> DataFrame:
    """(file, offset, line, tiebreak, row) of CSV files; ``row`` holds the fields and ``_corrupt`` where they do not fit."""
    lines = ordered_lines(spark, path, split_bytes).filter("line <> ''")
    if header:
        lines = lines.filter("offset > 0")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct.fields)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.withColumn("row", F.from_csv("line", f"{fields}, {CORRUPT} string", options))


def read_checked(
    spark: SparkSession,
    path: str,
    schema: LogSchema,
    struct: T.StructType,
    header: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Every row of CSV files as an event, with ``reason``, null where nothing is wrong, and ``file``, ``offset``, ``line``.

    The first reason that holds is named: the row's fields do not fit the types or their
    number, it has no session, no time, a time that cannot be read, or a label other than
    0 and 1.  A row without event is kept, as events may be null.
    """
    rows = _csv_lines(spark, path, struct, header, split_bytes)
    events = canonical(
        rows.select("tiebreak", "row.*", "file", "offset", "line"), replace(schema, tiebreak="tiebreak", extra=(*schema.extra, schema.ts, CORRUPT, "file", "offset", "line"))
    )
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "malformed row")
        .when(blank(F.col("session_id")), "no session")
        .when(blank(F.col(schema.ts)), "no time")
        .when(F.col("ts").isNull(), "unreadable time")
        .when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "unknown label")
    )
    return events.withColumn("reason", reason).drop(schema.ts, CORRUPT)


def kept_rows(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is null").drop("reason", "file", "offset", "line")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """(reason, file, offset, line) of the rows that are not kept, for a quarantine table."""
    return checked.filter("reason is not null").select("reason", "file", "offset", "line")


def write_quarantine(checked: DataFrame, path: str) -> None:
    """Append the rejected rows, one folder per reason."""
    rejected_rows(checked).write.partitionBy("reason").mode("append").parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, offset bigint, line string, reason string").parquet(path)


def read_ordered_lines(spark: SparkSession, path: str, ts_regex: str, ts_format: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``read_lines`` with a ``tiebreak`` that is the order of files and lines, the same for every read."""
    return _stamped(ordered_lines(spark, path, split_bytes), ts_regex, ts_format)


def read_lines(spark: SparkSession, path: str, ts_regex: str, ts_format: str) -> DataFrame:
    """Raw log lines (ts, tiebreak, line); ``tiebreak`` follows the order of lines in their file.

    It is a running number of the read, which grows along each file and differs between
    files.  Files are read in splits, not as a whole.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("tiebreak"))
    return _stamped(rows, ts_regex, ts_format)


def _stamped(rows: DataFrame, ts_regex: str, ts_format: str) -> DataFrame:
    stamp = F.nullif(F.regexp_extract("line", ts_regex, 0), F.lit(""))
    return rows.select(
        F.try_to_timestamp(stamp, F.lit(ts_format)).alias("ts"),
        "tiebreak",
        "line",
    )


def read_labels(spark: SparkSession, path: str, id_column: str, label_column: str, anomalous: str = "Anomaly") -> DataFrame:
    """Label per block (session_id, label) from a CSV file with header."""
    labels = spark.read.schema(f"`{id_column}` string, `{label_column}` string").csv(path, header=True)
    return labels.select(F.col(id_column).alias("session_id"), (F.col(label_column) == anomalous).cast("int").alias("label"))


def events_from_raw(
    lines: DataFrame,
    labels: DataFrame,
    id_regex: str,
    rules: list[str] = MASK_RULES,
    keep_unlabeled: bool = False,
    templates: DataFrame | None = None,
) -> DataFrame:
    """Events from raw lines (ts, tiebreak, line): one row per distinct block id in the line.

    ``labels`` is (session_id, label) per block.  Lines without a block id give no event.
    With ``templates`` learned from lines under the same rules (``operators.templates``) a
    line takes the one it fits; without, its masked text is its template.
    """
    ids = F.array_distinct(F.regexp_extract_all("line", F.lit(id_regex), F.lit(0)))
    if templates is None:
        lines = lines.withColumn("template", mask_template(F.col("line"), rules))
    else:
        lines = match_templates(lines, templates, "line", rules)
    found = lines.select(F.explode(ids).alias("session_id"), "ts", "tiebreak", "template").withColumn("event", event_id(F.col("template")))
    out = found.join(labels.select("session_id", "label"), "session_id", "left" if keep_unlabeled else "inner")
    return out.select("session_id", "ts", "tiebreak", "event", "label", "template")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(fmt).mode(mode).save(path)


def write_detections(detections: DataFrame, metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Per-session records and the one-row header, side by side under ``path``."""
    write_table(detections, f"{path}/results", fmt)
    write_table(metrics, f"{path}/metrics", fmt)


def result_records(detections: DataFrame, final_log: Column) -> DataFrame:
    """Detections in the stored result layout; lead and loss only where detected."""
    hit = F.col("predicted") == 1
    return detections.select(
        F.col("session_id").cast("string").alias("session_id"),
        F.col("label").cast("int").alias("label"),
        hit.alias("is_detected"),
        F.when(hit, F.col("lead_min")).alias("lead_time_minutes"),
        F.when(hit, F.col("alert_loss")).alias("alert_loss"),
        final_log.alias("final_log"),
    )


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and header written by ``write_detections`` in the stored result layout."""
    return (
        spark.read.schema(RESULT_FIELDS).json(f"{path}/results"),
        spark.read.schema("tp bigint, fp bigint, tn bigint, fn bigint, precision double, recall double, "
                          "accuracy double, specificity double, f1 double").json(f"{path}/metrics"),
    )


def read_topk_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and header of Top-K result files that nest all records in one JSON object."""
    whole = spark.read.schema(f"{TOPK_HEADER}, results array<struct<{TOPK_FIELDS}>>").json(path, multiLine=True)
    return whole.select(F.explode("results").alias("r")).select("r.*"), whole.drop("results")


def read_result_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records and header of threshold result files that nest all records in one JSON object."""
    whole = spark.read.schema(RESULT_FILE).json(path, multiLine=True)
    records = whole.select(F.explode("results").alias("r")).select("r.*")
    matrix = F.col("metrics.confusion_matrix")
    header = whole.select(
        "threshold",
        "metrics.precision",
        "metrics.recall",
        "metrics.f1",
        "metrics.accuracy",
        matrix[1][1].alias("tp"),
        matrix[0][1].alias("fp"),
        matrix[0][0].alias("tn"),
        matrix[1][0].alias("fn"),
    )
    return records, header


def save_threshold(threshold: DataFrame, path: str) -> None:
    """Store a calibrated threshold (one row: mean_loss, std_loss, k_sigma, threshold)."""
    threshold.coalesce(1).write.mode("overwrite").json(path)


def load_threshold(spark: SparkSession, path: str, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row with the stored threshold, or the default where none is stored."""
    one = spark.range(1).select(F.lit(float(default)).alias("_default"))
    try:
        stored = spark.read.schema("threshold double").json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return one.select(F.col("_default").alias("threshold"))
    stored = stored.agg(F.max("threshold").alias("threshold"))  # one row
    return one.join(F.broadcast(stored)).select(F.coalesce("threshold", "_default").alias("threshold"))


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("event string, token_id int").parquet(path)


def save_model(ngrams: DataFrame, path: str) -> None:
    ngrams.write.partitionBy("order").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "ctx string, next string, cnt bigint, ctx_cnt bigint, rank int, order int"
    ).parquet(path)
