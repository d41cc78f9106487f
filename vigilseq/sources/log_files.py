"""Line files as a data source that splits large files and knows the order of lines.

A partition is a range of bytes of one file.  A line belongs to the range in which it
begins, so any split gives the same rows (file_no, offset, line): the file's number in the
order of paths, and the line's first byte.  Both together are the order of a log that was
rotated over files whose names sort by time.  Small ranges grow with the log, so that their
number, and that of the files written from them, does not.

Files are opened through Arrow's file systems (local and shared folders, HDFS, S3, GCS).
Compressed files cannot be split and are refused; read them with ``tables.read_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "ordered_lines"
SCHEMA = "file string, file_no bigint, offset bigint, line string"
SPLIT_BYTES = 128 << 20
READ_BYTES = 4 << 20
TAIL_BYTES = 1 << 14  # read at a time to find the end of a range's last line
RANGES_PER_CORE = 4
MAX_RANGES = 1 << 20  # where the reader is not told how many cores there are
COMPRESSED = (".gz", ".bz2", ".zst", ".xz", ".lz4", ".snappy")
OFFSET_BITS = 43  # a file has up to 8 TiB, and there are up to a million files


@dataclass
class Range(InputPartition):
    file: str
    file_no: int
    start: int
    end: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri(path.replace("file:", "", 1))


def log_files(path: str) -> list[tuple[str, int]]:
    """Files under a path with their sizes, in the order of their names; hidden ones are left out."""
    store, root = _open(path)
    top = store.get_file_info(root)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
    visible = [f for f in found if f.is_file and not any(part[:1] in "._" for part in f.path[len(root) :].split("/") if part)]
    for f in visible:
        if f.path.endswith(COMPRESSED):
            raise ValueError(f"{f.path} is compressed and cannot be read in ranges")
    return sorted((f.path, f.size) for f in visible)


def range_bytes(total: int, split_bytes: int, ranges: int) -> int:
    """Bytes of a range: ``split_bytes``, or more, up to ``SPLIT_BYTES``, where files of ``total`` bytes have over ``ranges`` of them."""
    return max(split_bytes, min(SPLIT_BYTES, -(-total // ranges)))


def lines_of(file, start: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Offsets and lines, a block at a time, of the lines that begin in ``[start, end)``.

    Lines end at a line feed; a carriage return before it is left out.  Behind the range
    only the rest of its last line is read.
    """
    at = max(0, start - 1)  # the byte before tells whether a line begins at ``start``
    file.seek(at)
    skip = start > 0
    held = b""
    while at < end or held:
        block = file.read(min(read_bytes, max(end - at - len(held), len(held), TAIL_BYTES)))
        data = held + block
        if not data:
            return
        lines = data.split(b"\n")
        held = lines.pop() if block else b""
        if not block and lines and not lines[-1]:
            lines.pop()
        if skip and lines:
            at += len(lines.pop(0)) + 1
            skip = False
        if skip and at + len(held) >= end:
            return  # no line begins in the range
        offsets, kept = [], []
        for line in lines:
            if at >= end:
                held = b""
                break
            offsets.append(at)
            kept.append(line[:-1] if line.endswith(b"\r") else line)
            at += len(line) + 1
        if offsets:
            yield offsets, kept
        if at >= end or not block:
            return


class LineReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, ranges: int) -> None:
        self.path, self.split_bytes, self.ranges = path, split_bytes, ranges

    def partitions(self) -> Sequence[InputPartition]:
        files, ranges = log_files(self.path), []
        step = range_bytes(sum(size for _, size in files), self.split_bytes, self.ranges)
        for number, (file, size) in enumerate(files):
            ranges += [Range(file, number, at, min(at + step, size)) for at in range(0, size, step)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        store, _ = _open(self.path)
        with store.open_input_file(partition.file) as file:
            for offsets, lines in lines_of(file, partition.start, partition.end):
                n = len(lines)
                texts = pa.array([t.decode("utf-8", "replace") for t in lines], pa.string())
                columns = [pa.array([partition.file] * n), pa.array([partition.file_no] * n, pa.int64()), pa.array(offsets, pa.int64()), texts]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "file_no", "offset", "line"])


class OrderedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        split_bytes = int(self.options.get("splitbytes", SPLIT_BYTES))
        return LineReader(self.options["path"], split_bytes, int(self.options.get("ranges", MAX_RANGES)))


def ordered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, file_no, offset, line, tiebreak) of the files under a path; ``tiebreak`` is the order of files and lines.

    Ranges have ``split_bytes`` as long as there are at most ``RANGES_PER_CORE`` of them for a core, see ``range_bytes``.
    """
    spark.dataSource.register(OrderedLines)
    ranges = RANGES_PER_CORE * spark.sparkContext.defaultParallelism
    rows = spark.read.format(FORMAT).options(splitBytes=split_bytes, ranges=ranges).load(path)
    return rows.withColumn("tiebreak", F.shiftleft("file_no", OFFSET_BITS) + F.col("offset"))
