"""Order-dependent primitives that hold when one group has most of the rows.

``running_totals`` numbers rows and sums along an order inside each group.  Rows
are range-partitioned by (keys, order) and stored, so that a large group spreads
over many tasks.  Sums run inside the pieces; a group that goes on from the piece
before starts from the totals of its earlier pieces.  A piece has one such group at
most, so the offsets are one row per piece, and nothing is counted beforehand.

``with_halo`` prepares bounded look-back and look-ahead (lag, framed lists): rows
already numbered by ``pos`` are cut in chunks of fixed length and the few rows
next to a chunk's edge are copied into the neighbouring chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.sources.staging import stage

CHUNK_ROWS = 65_536  # rows of one session that a look-back window holds
SMALL_ROWS = 200_000  # rows of a summary that are ordered without ranges
SMALL_BYTES = 32 << 20  # estimated size of a log whose largest group may be one task's work


def _name(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True)
    )


def _before(column: Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    running: dict[str, Column],
    totals: dict[str, Column] | None = None,
    previous: tuple[str, int] | None = None,
    pieces: int | None = None,
    summary: bool = False,
    small_bytes: int = 0,
) -> DataFrame:
    """Add per row the sum of ``running`` over the rows before it in its group.

    ``order`` should be unique inside a group.  ``totals`` are aggregates over the
    whole group (``{"n": F.count("*")}``), repeated on each of its rows.  ``previous``
    is a column and a number n: its values in the n rows before become ``prev1`` (the
    nearest) to ``prevn``.  ``pieces`` is the number of ranges, by default the number
    of shuffle partitions.

    ``summary`` says that ``df`` has been reduced to one row per distinct value.  It is
    stored and counted, and up to ``SMALL_ROWS`` rows are ordered by windows at once.
    So is a ``df`` of at most ``small_bytes`` by the optimizer's estimate, unless the number
    of pieces is given.
    """
    keys, totals = list(keys), totals or {}
    look_back, depth = previous or ("", 0)
    if summary:
        df = stage(df, "summary")
        if df.count() <= SMALL_ROWS:
            return _by_windows(df, keys, order, running, totals, look_back, depth)
    if small_bytes and pieces is None and estimated_bytes(df) <= small_bytes:
        return _by_windows(df, keys, order, running, totals, look_back, depth)
    values = {f"_v_{n}": c for n, c in running.items()}
    place = [_name(c) for c in [*keys, *order]]
    rows = df.withColumns(values)
    rows = rows.repartitionByRange(pieces, *place) if pieces else rows.repartitionByRange(*place)
    # Stored, as piece numbers must not change between the reads below.
    rows = stage(rows.withColumn("_piece", F.spark_partition_id()), "ranged")

    # One row per piece: its first and last group, and the sums of the last one.
    key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_all"))
    parts = rows.groupBy("_piece", key.alias("_key")).agg(*[F.sum(v).alias(v) for v in values])
    last = F.max_by(F.struct(*values), "_key") if values else F.lit(None)
    ends = parts.groupBy("_piece").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"), last.alias("_sums"))
    ends = ends.select("_piece", "_first", "_last", *[F.col(f"_sums.{v}").alias(v) for v in values])
    along, alike = Window.orderBy("_piece"), Window.partitionBy("_last").orderBy("_piece")
    ends = ends.coalesce(1)  # one row per piece: both windows need no more shuffles
    ends = ends.withColumns({v: F.sum(v).over(alike) for v in values})
    if depth:
        at_end = rows.join(F.broadcast(ends.select("_piece", "_last")), "_piece").filter(key.eqNullSafe(F.col("_last")))
        from_end = F.row_number().over(Window.partitionBy("_piece").orderBy(*[_reversed(c) for c in order]))
        nearest = at_end.withColumn("_n", from_end).filter(F.col("_n") <= depth).groupBy("_piece")
        nearest = nearest.agg(F.sort_array(F.collect_list(F.struct("_n", F.col(look_back).alias("_value")))).alias("_near"))
        ends = ends.join(F.broadcast(nearest), "_piece")
        earlier = F.flatten(F.reverse(F.collect_list("_near").over(alike)))  # nearest first
        ends = ends.withColumn("_near", F.slice(earlier, 1, depth))
    goes_on = F.lag("_last").over(along).eqNullSafe(F.col("_first")) & (F.row_number().over(along) > 1)
    offsets = ends.select(
        "_piece",
        "_first",
        goes_on.alias("_goes_on"),
        *([F.lag("_near").over(along).alias("_near")] if depth else []),
        *[F.coalesce(F.lag(v).over(along), F.lit(0)).alias(f"_o_{n}") for n, v in zip(running, values)],
    ).filter("_goes_on")
    # At most one row per piece: the groups that go on from the piece before.
    out = rows.join(F.broadcast(offsets.withColumnRenamed("_piece", "_p")), F.col("_piece") == F.col("_p"), "left")
    goes_on = F.col("_goes_on") & key.eqNullSafe(F.col("_first"))

    inside = Window.partitionBy("_piece", *keys).orderBy(*order)
    out = out.withColumns(
        {n: _before(F.col(v), inside) + F.when(goes_on, F.col(f"_o_{n}")).otherwise(0) for n, v in zip(running, values)}
    )
    at = F.row_number().over(inside)
    for i in range(1, depth + 1):
        kept = F.try_element_at(F.col("_near"), (F.lit(i + 1) - at).cast("int"))["_value"]
        out = out.withColumn(f"prev{i}", F.when(at > i, F.lag(look_back, i).over(inside)).when(goes_on, kept))
    if totals and not keys:
        whole = F.broadcast(rows.agg(*[c.alias(n) for n, c in totals.items()]))  # one row
        out = out.join(whole)
    elif totals:
        # The same order for all, so that one window operator serves them.
        group = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cut = F.broadcast(offsets.select("_first.*").drop("_all").distinct())
        whole = rows.join(cut, _match(rows, cut, keys), "left_semi").groupBy(*keys)
        whole = whole.agg(*[c.alias(f"_t_{n}") for n, c in totals.items()], F.lit(True).alias("_cut"))
        whole = F.broadcast(whole.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_cut", *[f"_t_{n}" for n in totals]))
        same = reduce(lambda a, b: a & b, [out[k].eqNullSafe(whole[f"_k_{k}"]) for k in keys], F.lit(True))
        out = out.withColumns({n: c.over(group) for n, c in totals.items()}).join(whole, same, "left")
        out = out.withColumns({n: F.when(F.col("_cut"), F.col(f"_t_{n}")).otherwise(F.col(n)) for n in totals})
    return out.select(*df.columns, *[f"prev{i}" for i in range(1, depth + 1)], *running, *totals)


def estimated_bytes(df: DataFrame) -> int:
    """Size of a frame by the statistics of its plan; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _by_windows(
    df: DataFrame, keys: list[str], order: Sequence[str | Column], running: dict[str, Column], totals: dict[str, Column], look_back: str, depth: int
) -> DataFrame:
    inside = Window.partitionBy(*keys).orderBy(*order)
    group = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = {f"prev{i}": F.lag(look_back, i).over(inside) for i in range(1, depth + 1)}
    added |= {n: _before(c, inside) for n, c in running.items()} | {n: c.over(group) for n, c in totals.items()}
    return df.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def _reversed(c: str | Column) -> Column:
    """Descending order of a name; other columns are turned round by the caller's own descending form."""
    if not isinstance(c, str):
        raise ValueError("look-back needs an order given by names")
    return F.desc(c)


def with_halo(
    df: DataFrame,
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = ("session_id",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; edge rows appear in the next / previous chunk too.

    A window over (keys, _chunk) ordered by ``pos`` then sees the ``back`` rows
    before and the ``ahead`` rows after each row.  Drop ``_halo`` rows afterwards.
    """
    if max(back, ahead) >= chunk_rows:
        raise ValueError("look-back must be shorter than a chunk")
    chunk = F.floor(F.col("pos") / chunk_rows)
    inside = F.col("pos") % chunk_rows
    copies = [chunk]
    if back:
        copies.append(F.when(inside >= chunk_rows - back, chunk + 1))
    if ahead:
        copies.append(F.when((inside < ahead) & (chunk > 0), chunk - 1))
    out = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    return out.withColumn("_halo", F.col("_chunk") != F.floor(F.col("pos") / chunk_rows))


def chunk_window(keys: Sequence[str] = ("session_id",)):
    return Window.partitionBy(*keys, "_chunk").orderBy("pos")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_chunk", "_halo")


def quantiles(
    df: DataFrame,
    column: str,
    qs: dict[str, float],
    by: Sequence[str] = (),
    pieces: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column per name in ``qs``.

    Rows are collapsed to distinct values first; the values around each wanted
    rank are found by running counts, so no group is held by one task.
    """
    by = list(by)
    values = df.filter(F.col(column).isNotNull())
    counts = values.groupBy(*by, F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_cnt"))
    placed = running_totals(
        counts, by, ["_value"], {"_start": F.col("_cnt")}, {"_n": F.sum("_cnt")}, pieces=pieces, summary=pieces is None
    )

    def at(rank: Column) -> Column:
        inside = (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_cnt"))
        return F.max(F.when(inside, F.col("_value").cast("double")))

    parts, final = [], []
    for i, (name, q) in enumerate(qs.items()):
        rank = (F.col("_n") - 1) * F.lit(float(q))
        parts += [at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}")]
        top = (F.col("_count") - 1) * F.lit(float(q))
        step = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        final.append((F.col(f"_lo{i}") + step * (top - F.floor(top))).alias(name))
    found = placed.groupBy(*by).agg(F.max("_n").alias("_count"), *parts)
    return found.select(*by, *final)
