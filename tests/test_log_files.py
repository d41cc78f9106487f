"""Line files read in ranges: every line once, in the order of files and bytes, however they are split."""

import io

import pytest

from vigilseq import schema
from vigilseq.plans import catalog, logs
from vigilseq.sources import log_files, tables

TEXT = b"first\r\n\nsecond line\nthird \xc3\xa9\xff\n" + b"x" * 300 + b"\nlast without end"


def plain(data):
    out, at = [], 0
    for line in data.split(b"\n"):
        if at < len(data):
            out.append((at, line.removesuffix(b"\r")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("data", [TEXT, TEXT + b"\n", b"", b"\n", b"\n\n", b"one"])
@pytest.mark.parametrize("split", [1, 2, 7, 50, 10_000])
@pytest.mark.parametrize("block", [1, 16, 4096])
def test_ranges_hold_every_line_once(data, split, block):
    found = []
    for start in range(0, len(data), split):
        for offsets, lines in log_files.lines_of(io.BytesIO(data), start, min(start + split, len(data)), block):
            found += zip(offsets, lines)
    assert found == plain(data)


def test_files_in_the_order_of_their_names(spark, tmp_path):
    for name, lines in (("b.log", ["3", "4"]), ("a.log", ["1", "2"]), ("_hidden", ["no"]), ("c.log", ["", "5"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    for split in (1, 3, 1000):
        rows = log_files.ordered_lines(spark, str(tmp_path), split).orderBy("tiebreak").collect()
        assert [r["line"] for r in rows] == ["1", "2", "3", "4", "", "5"]
        assert [(r["file_no"], r["offset"]) for r in rows] == [(0, 0), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert log_files.ordered_lines(spark, f"file://{tmp_path}/a.log", 2).rdd.getNumPartitions() == 2


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    n_read = 0

    def read(self, size=-1):
        block = super().read(size)
        self.n_read += len(block)
        return block


def test_small_ranges_read_little_behind_their_end():
    file, split = Counted(b"a line of a log, as long as others\n" * 60_000), 1 << 14
    size = len(file.getvalue())
    for start in range(0, size, split):
        assert sum(len(o) for o, _ in log_files.lines_of(file, start, min(start + split, size))) > 0
    assert file.n_read < 3 * size


def test_a_line_over_many_ranges_is_read_once():
    file, split = Counted(b"x" * 4_000_000 + b"\nlast\n"), 1 << 14
    size, found = len(file.getvalue()), []
    for start in range(0, size, split):
        for offsets, _ in log_files.lines_of(file, start, min(start + split, size)):
            found += offsets
    assert found == [0, 4_000_001] and file.n_read < 4 * size


def test_ranges_do_not_grow_in_number(spark, tmp_path):
    """Ten times the log has as many ranges, and as many files of rejected rows; large ranges stay as asked for."""
    found = []
    for name, n in (("small", 2_000), ("large", 20_000)):
        (tmp_path / f"{name}.csv").write_text("".join(f"s{i},2024-01-01 00:00:01,a,{i % 3}\n" for i in range(n)))
        checked = tables.read_checked(spark, str(tmp_path / f"{name}.csv"), schema.HDFS, schema.STRUCTS["hdfs"], header=False, split_bytes=1 << 11)
        tables.write_quarantine(checked, str(tmp_path / name))
        rejected = tables.read_quarantine(spark, str(tmp_path / name))
        assert rejected.count() == n // 3
        found.append((checked.rdd.getNumPartitions(), len(rejected.inputFiles())))
    assert found[0] == found[1]
    assert log_files.range_bytes(1 << 40, log_files.SPLIT_BYTES, 8) == log_files.range_bytes(100, log_files.SPLIT_BYTES, 8) == log_files.SPLIT_BYTES
    assert log_files.range_bytes(1 << 40, 1 << 14, 8) == log_files.SPLIT_BYTES and log_files.range_bytes(100, 1 << 14, 8) == 1 << 14


def test_what_cannot_be_read(spark, tmp_path):
    with pytest.raises(Exception, match="missing"):
        log_files.ordered_lines(spark, str(tmp_path / "missing")).collect()
    (tmp_path / "a.log.gz").write_bytes(b"")
    with pytest.raises(Exception, match="compressed"):
        log_files.ordered_lines(spark, str(tmp_path)).collect()


def test_rows_of_one_time_keep_the_order_of_the_files(spark, tmp_path):
    for part in range(3):
        rows = [f"R{i % 2},100,event {part * 40 + i},0" for i in range(40)]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(["node_id,timestamp,EventTemplate,label", *rows]) + "\n")
    log = tables.read_events_in_order(spark, str(tmp_path), schema.BGL, schema.STRUCTS["bgl"], split_bytes=64)
    assert log.columns == schema.EVENT_COLUMNS
    assert [r["event"] for r in log.orderBy("ts", "tiebreak").collect()] == [f"event {i}" for i in range(120)]


def test_rejected_rows_name_their_reason(spark, tmp_path):
    good = ["s1,2024-01-01 00:00:01,\"a, \"\"b\"\"\",0", "s2,2024-01-01 00:00:02,,1"]
    bad = {
        "s1,2024-01-01 00:00:01,a,0,more": "malformed row",
        "s1,2024-01-01 00:00:01,a": "malformed row",
        "s1,2024-01-01 00:00:01,a,yes": "malformed row",
        " ,2024-01-01 00:00:01,a,0": "no session",
        "s1,,a,0": "no time",
        "s1,yesterday,a,0": "unreadable time",
        "s1,2024-01-01 00:00:01,a,7": "unknown label",
        "s1,2024-01-01 00:00:01,a,": "unknown label",
    }
    lines = ["session_id,timestamp,EventTemplate,anom_label", *good, *bad]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    checked = tables.read_checked(spark, str(tmp_path / "log.csv"), schema.HDFS, schema.STRUCTS["hdfs"], split_bytes=100)
    kept, rejected = tables.kept_rows(checked), tables.rejected_rows(checked)
    assert kept.columns == schema.EVENT_COLUMNS
    assert sorted((r["session_id"], r["event"], r["label"]) for r in kept.collect()) == [("s1", 'a, "b"', 0), ("s2", None, 1)]
    assert {r["line"]: r["reason"] for r in rejected.collect()} == bad
    for r in rejected.collect():
        data = (tmp_path / "log.csv").read_bytes()
        assert data[r["offset"] :].split(b"\n")[0].decode() == r["line"]
    path = str(tmp_path / "quarantine")
    tables.write_quarantine(checked, path)
    assert tables.read_quarantine(spark, path).count() == len(bad)
    assert kept.count() + rejected.count() == len(good) + len(bad)


def test_kept_rows_are_the_same_for_all_ranges(spark, tmp_path):
    """Ranges of any size keep the same rows, in no more tasks than small files need."""
    lines = [f"s{i % 7},2024-01-01 00:00:{i % 60:02d},event {i},{i % 3}" for i in range(3_000)]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    found, most = [], log_files.RANGES_PER_CORE * spark.sparkContext.defaultParallelism
    for split in (64, 1 << 12, 1 << 20):
        kept = tables.kept_rows(tables.read_checked(spark, str(tmp_path / "log.csv"), schema.HDFS, schema.STRUCTS["hdfs"], header=False, split_bytes=split))
        assert kept.rdd.getNumPartitions() <= most
        found.append([r["event"] for r in kept.orderBy("tiebreak").collect()])
    assert found[0] == found[1] == found[2] == [f"event {i}" for i in range(3_000) if i % 3 < 2]


def test_a_large_log_is_written_to_more_files(spark, monkeypatch):
    log = spark.range(1_000)
    assert catalog._files(log) == catalog.FILES
    monkeypatch.setattr(logs, "FILE_ROWS", 100)
    assert catalog._files(log) == catalog.FILES + 10
