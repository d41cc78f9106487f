"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseq.sources.staging import stage

LEAST = -(2**63)  # stands for a null id where a plain integer is needed
BROADCAST_ROWS = 200_000  # rows of a lookup table that are sent to every executor


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def ids(column: pa.Array) -> np.ndarray:
    """Ids as int64; null becomes the least integer."""
    return column.cast(pa.int64()).fill_null(LEAST).to_numpy(zero_copy_only=False)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 200_000
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a stream sorted by ``keys``, with the row where each group starts.

    A table has about ``rows`` rows, or those of one group where that is larger.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table, keys)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        held = table.slice(last).combine_chunks().to_batches()
        n = table.num_rows - last
        rows = max(rows, 2 * n)  # one large group is not cut again and again
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (fixed constants of a public finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def local_roots(n: int, left: np.ndarray, right: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Least row reachable from each of ``n`` rows over the given pairs of rows."""
    root = np.arange(n) if root is None else root
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    return root


def look_up(rows: DataFrame, table: DataFrame, key: str, rows_limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join on ``key`` with a written table of one row per key, sent to the executors if it is small.

    Beyond the limit it is a plain join, whose hot keys adaptive execution splits.
    """
    return rows.join(F.broadcast(table) if table.count() <= rows_limit else table, key, "left")


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written to the shared folder with a row number ``_row`` that stays the same."""
    return stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, dropped: DataFrame, rows_limit: int = BROADCAST_ROWS) -> DataFrame:
    """Numbered rows that are not in ``dropped(_row)``; few dropped rows are sent to the executors."""
    gone = stage(dropped.select("_row"), "dropped")
    return rows.join(F.broadcast(gone) if gone.count() <= rows_limit else gone, "_row", "left_anti")
