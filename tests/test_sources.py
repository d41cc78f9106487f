import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from vigilseq import schema
from vigilseq.operators import evaluate, rows, vocab
from vigilseq.sources import staging, tables


def test_csv_with_quotes_nulls_and_bad_times(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        'session_id,timestamp,EventTemplate,anom_label\nblk_1,2024-01-01 00:00:01,"a ""b"", c",0\nblk_1,oops,,1\n'
    )
    log = tables.read_events(spark, str(path), schema.HDFS, "csv", schema.STRUCTS["hdfs"])
    assert log.columns == schema.EVENT_COLUMNS
    assert rows_of(log.select("event", "label").filter("event is not null")) == [('a "b", c', 0)]
    assert log.filter("ts is null").count() == 1 and rows.normal_rows(log).count() == 1


def test_csv_with_line_breaks(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('session_id,timestamp,EventTemplate,anom_label\ns,2024-01-01 00:00:01,"one\ntwo",0\n')
    log = tables.read_events(spark, str(path), schema.HDFS, "csv", schema.STRUCTS["hdfs"], multi_line=True)
    assert log.first()["event"] == "one\ntwo"


def test_epoch_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("node_id,timestamp,EventTemplate,label\nR02,1117838570,instruction cache parity error,0\n")
    log = tables.read_events(spark, str(path), schema.BGL, "csv", schema.STRUCTS["bgl"])
    assert log.select(F.unix_seconds("ts")).first()[0] == 1117838570


def test_csv_needs_types(spark):
    with pytest.raises(ValueError):
        tables.read_events(spark, "x", schema.HDFS, "csv")


def test_parquet_reads_only_the_log_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(3).select(
        F.col("id").alias("s"), F.timestamp_seconds("id").alias("t"), F.lit("e").alias("e"), F.lit(0).alias("y"),
        F.lit("wide").alias("unused"), F.col("id").alias("n"),
    ).write.parquet(path)
    log = tables.read_events(spark, path, schema.LogSchema("s", "t", "e", "y", "n"))
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and log.count() == 3


def test_raw_lines(spark):
    lines = spark.createDataFrame(
        [(1, "Served blk_7 and blk_-8 and blk_7 to /10.0.0.1:5"), (2, "no block"), (3, "Deleting blk_9")], "tiebreak long, line string"
    ).withColumn("ts", F.timestamp_seconds("tiebreak"))
    labels = spark.createDataFrame([("blk_7", 0), ("blk_-8", 1)], "session_id string, label int")
    inner = tables.events_from_raw(lines, labels, r"blk_-?[0-9]+")
    assert rows_of(inner.select("session_id", "label")) == [("blk_-8", 1), ("blk_7", 0)]
    assert inner.first()["template"] == "Served <*> and <*> and <*> to /<*>"
    left = tables.events_from_raw(lines, labels, r"blk_-?[0-9]+", keep_unlabeled=True)
    assert left.filter("label is null").first()["session_id"] == "blk_9"


def test_raw_files(spark, tmp_path):
    lines = [f"081109 2035{i // 10:02d} {i} INFO dfs: Receiving block blk_{i % 2}" for i in range(60)] + ["no time blk_0"]
    (tmp_path / "raw.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "labels.csv").write_text("BlockId,Label\nblk_0,Normal\nblk_1,Anomaly\n")
    raw = tables.read_lines(spark, str(tmp_path / "raw.log"), r"^[0-9]{6} [0-9]{6}", "yyMMdd HHmmss")
    assert [r["line"] for r in raw.orderBy("tiebreak").collect()] == lines
    assert raw.filter("ts is null").count() == 1
    assert raw.agg(F.min("ts").cast("string")).first()[0] == "2008-11-09 20:35:00"
    labels = tables.read_labels(spark, str(tmp_path / "labels.csv"), "BlockId", "Label")
    events = tables.events_from_raw(raw, labels, r"blk_-?[0-9]+")
    assert rows_of(events.groupBy("session_id", "label").count()) == [("blk_0", 0, 31), ("blk_1", 1, 30)]


def test_threshold_file(spark, tmp_path):
    path = tmp_path / "threshold_config.json"
    assert tables.load_threshold(spark, str(path)).first()[0] == 5.0
    path.write_text(json.dumps({"mean_loss": 0.016, "k_sigma": 8.0, "threshold": 0.28632830299979956}, indent=4))
    assert tables.load_threshold(spark, str(path)).first()[0] == 0.28632830299979956
    path.write_text('{"mean_loss": 1.0}')
    assert tables.load_threshold(spark, str(path), 4.0).first()[0] == 4.0


def test_nested_result_files(spark, tmp_path):
    path = tmp_path / "results.json"
    record = {"session_id": "b1", "label": 1, "is_detected": True, "lead_time_minutes": 2.5, "alert_loss": 0.4, "final_log": "x..."}
    path.write_text(json.dumps({"metrics": {"precision": 1.0, "recall": 0.5, "f1": 0.66, "accuracy": 0.9, "confusion_matrix": [[7, 1], [2, 3]]},
                                "threshold": 0.28, "results": [record, {**record, "session_id": "b2", "lead_time_minutes": None}]}, indent=2))
    records, header = tables.read_result_file(spark, str(path))
    assert [r["session_id"] for r in records.orderBy("session_id").collect()] == ["b1", "b2"]
    row = header.first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["threshold"]) == (7, 1, 2, 3, 0.28)

    path.write_text(json.dumps({"detection_method": "Top-5", "precision": 1.0, "tp": 4, "results": [{"test_id": 9, "label": 1, "predicted": 1, "first_anomaly_step": 3}]}))
    records, header = tables.read_topk_file(spark, str(path))
    assert records.first()["first_anomaly_step"] == 3 and header.first()["tp"] == 4


def test_written_detections_come_back(spark, tmp_path):
    found = spark.createDataFrame([("a", 1, 1, 2.5, 0.4), ("b", 0, 0, None, 0.0)], "session_id string, label int, predicted int, lead_min double, alert_loss double")
    records = tables.result_records(found, F.lit("log..."))
    tables.write_detections(records, evaluate.class_metrics(evaluate.confusion(found)), str(tmp_path / "out"))
    stored, header = tables.read_results(spark, str(tmp_path / "out"))
    assert rows_of(stored.select("session_id", "is_detected")) == [("a", True), ("b", False)]
    assert stored.filter("session_id = 'b'").first()["alert_loss"] is None and header.first()["f1"] == 1.0


def test_vocabulary_file(spark, tmp_path, events):
    known = vocab.with_special(vocab.fit_vocab(events([(1, 0, "z", 0), (1, 1, "a", 0)])))
    tables.save_vocab(known, str(tmp_path / "vocab"))
    assert rows_of(tables.load_vocab(spark, str(tmp_path / "vocab"))) == [("<PAD>", 0), ("<SEP>", 2), ("<UNK>", 1), ("a", 3), ("z", 4)]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        conf = Conf(**{"spark.master": "yarn"})

    with pytest.raises(ValueError):
        staging.staging_root(Session())
    Session.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://nn/shared/"})
    assert staging.staging_root(Session()) == "hdfs://nn/shared"


def test_template_and_other_columns_survive(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "E1", "t <*>", "t 5", "svc", 0), (1, "2024-01-01 00:00:00", "E2", None, "u", "svc", 1)]
    table = spark.createDataFrame(
        rows, "test_id long, timestamp string, EventId string, EventTemplate string, Content string, service string, anom_label int"
    )
    table.coalesce(1).write.parquet(str(tmp_path / "log"))
    log = tables.read_events(spark, str(tmp_path / "log"), schema.OPENSTACK)
    assert log.columns == ["session_id", "ts", "tiebreak", "event", "label", "template", "Content", "service"]
    assert [r["event"] for r in log.orderBy("ts", "tiebreak").collect()] == ["E1", "E2"]


def test_equal_times_keep_the_order_of_each_file(spark, tmp_path):
    for part in ("a", "b"):
        (tmp_path / f"{part}.log").write_text("".join(f"2024-01-01 00:00:00 {part}{i}\n" for i in range(3)))
    raw = tables.read_lines(spark, str(tmp_path), r"^\S+ \S+", "yyyy-MM-dd HH:mm:ss")
    rows = raw.orderBy("ts", "tiebreak").collect()
    assert len({(r["ts"], r["tiebreak"]) for r in rows}) == 6
    for part in ("a", "b"):
        assert [r["line"][-2:] for r in rows if r["line"][-2] == part] == [f"{part}{i}" for i in range(3)]
