"""Shards of near-equal bytes by a k-d tree over the metadata of documents.

A node holds some rows and is to become some number of shards.  It is cut along its
widest dimension (extent in units of the whole table's extent) where half of its shards,
rounded down, take their part of its bytes: the weighted median, or the weighted quantile
next to it.  The place of a row in a node is an exact running sum along (dimension, id,
row number), computed for all nodes of a level at once by ranges, so neither a node nor a
value shared by many rows is ever held by one task.  All nodes with two shards or more are
cut until each is one shard.

Only metadata move: the text is read once for its size.  The tree itself is a few numbers
per node, at most one node per shard.

Sizes are UTF-8 bytes plus ``ROW_BYTES``, so null and empty texts count too.  Null
metadata stand below all values.  Equal rows are told apart by row number and may be
parted.  Input columns are kept, but for those named like the added
ones; names that begin with ``_kd`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.operators.ordered import running_totals
from vigilseq.sources.staging import stage

ROW_BYTES = 8


def text_size(text_col: str = "text") -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + ROW_BYTES


def _as_number(df: DataFrame, name: str) -> Column:
    """Numbers as they are; other values by a hash, which keeps equal ones together."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.col(name).cast("double")
    return F.when(F.col(name).isNotNull(), F.xxhash64(name).cast("double"))


def kd_shards(rows: DataFrame, size: Column, dimensions: Sequence[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Add ``shard`` (from 0), ``slot`` (from 0 without gaps in each shard) and ``size`` to every row.

    Give the number of shards, or the bytes a shard should have.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    table = stage(rows.withColumns({"_kd_row": F.monotonically_increasing_id(), "_kd_size": size}), "rows")
    axes = [f"_kd_{i}" for i in range(len(dimensions))]
    raw = table.select("_kd_row", "_kd_size", *[_as_number(table, d).alias(a) for a, d in zip(axes, dimensions)])
    extent = raw.agg(
        F.sum("_kd_size").alias("total"), *[F.min(a).alias(f"lo{a}") for a in axes], *[F.max(a).alias(f"hi{a}") for a in axes]
    ).first()
    if shards is None:
        shards = max(1, -(-int(extent["total"] or 0) // target_bytes))

    def scaled(a: str) -> Column:
        lo, hi = extent[f"lo{a}"], extent[f"hi{a}"]
        if lo is None or not hi > lo:
            return F.lit(0.0)
        return F.coalesce((F.col(a) - lo) / (hi - lo), F.lit(-1e-9))

    nodes = stage(
        raw.select("_kd_row", "_kd_size", *[scaled(a).alias(a) for a in axes], F.lit(0).alias("_kd_first"), F.lit(shards).alias("_kd_n")), "nodes"
    )
    done: list[DataFrame] = []
    left = shards
    while left > 1:
        done.append(nodes.filter("_kd_n = 1"))
        nodes = stage(_cut(nodes.filter("_kd_n > 1"), axes), "nodes")
        left = -(-left // 2)
    for part in done:
        nodes = nodes.unionByName(part)
    placed = running_totals(nodes.select("_kd_row", "_kd_first"), ["_kd_first"], ["_kd_row"], {"_kd_slot": F.lit(1).cast("bigint")})
    added = {"shard": "_kd_first", "slot": "_kd_slot", "size": "_kd_size"}
    kept = [c for c in rows.columns if c not in added]
    # As many rows on both sides at every size, so neither is ever sent to all executors.
    return table.join(placed.hint("merge"), "_kd_row").select(*kept, *[F.col(c).alias(name) for name, c in added.items()])


def _cut(nodes: DataFrame, axes: list[str]) -> DataFrame:
    """Rows of the next level: every node in two."""
    node = ["_kd_first", "_kd_n"]
    widths = nodes.groupBy(*node).agg(*[(F.max(a) - F.min(a)).alias(f"w{a}") for a in axes])
    widest = F.greatest(*[f"w{a}" for a in axes]) if len(axes) > 1 else F.col(f"w{axes[0]}")
    choice = F.coalesce(*[F.when(F.col(f"w{a}") == widest, i) for i, a in enumerate(axes)])
    chosen = widths.select(*node, choice.alias("_kd_axis"))
    value = F.element_at(F.array(*axes), F.col("_kd_axis") + 1)
    rows = nodes.join(F.broadcast(chosen), node).withColumn("_kd_value", value)  # at most one row per shard
    placed = running_totals(rows, node, ["_kd_value", "_kd_row"], {"_kd_before": F.col("_kd_size")}, {"_kd_total": F.sum("_kd_size")})
    half = F.floor(F.col("_kd_n") / 2).cast("int")
    goes_left = (F.col("_kd_before") + F.col("_kd_size") / 2) * F.col("_kd_n") <= F.col("_kd_total") * half
    return placed.select(
        "_kd_row",
        "_kd_size",
        *axes,
        (F.col("_kd_first") + F.when(goes_left, 0).otherwise(half)).alias("_kd_first"),
        F.when(goes_left, half).otherwise(F.col("_kd_n") - half).alias("_kd_n"),
    )


def document_shards(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per document."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", text_size().alias("bytes"), crc.alias("text_crc32"), "lang", "source")
    found = kd_shards(rows, F.col("bytes"), ["bytes", "source", "lang", "doc_id"], shards)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
