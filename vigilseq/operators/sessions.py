"""Sessions, positions and windows over event order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.functions.numeric import minutes_between
from vigilseq.operators.ordered import (
    CHUNK_ROWS,
    SMALL_BYTES,
    chunk_window,
    drop_halo,
    running_totals,
    with_halo,
)
from vigilseq.schema import EVENT_ORDER


def with_position(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """0-based position of each event in its session, by (ts, tiebreak)."""
    return running_totals(events, ["session_id"], EVENT_ORDER, {"pos": F.lit(1)}, pieces=pieces, small_bytes=SMALL_BYTES)


def sessionize(events: DataFrame) -> DataFrame:
    """Position plus session label and length."""
    return sessionize_with_previous(events, 0)


def sessionize_with_previous(events: DataFrame, order: int, pieces: int | None = None, timed: bool = False) -> DataFrame:
    """``sessionize`` and ``with_previous`` together, in the same shuffles.

    Rows without time come first.  ``timed`` leaves out sessions that have such rows.
    """
    out = running_totals(
        events,
        ["session_id"],
        EVENT_ORDER,
        {"pos": F.lit(1)},
        {"session_label": F.max("label"), "n_events": F.count(F.lit(1)), "_untimed": F.count_if(F.col("ts").isNull())},
        ("event", order),
        pieces,
        small_bytes=SMALL_BYTES,
    )
    return (out.filter("_untimed = 0") if timed else out).drop("_untimed")


def session_labels(events: DataFrame) -> DataFrame:
    """A session is anomalous when any of its rows is."""
    return events.groupBy("session_id").agg(F.max("label").alias("label"))


def session_lengths(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"))


def session_sequences(positioned: DataFrame, sep: str | None = None, *, max_events: int) -> DataFrame:
    """Ordered event list per (session, chunk), or text joined by ``sep``.

    A row holds at most ``max_events`` events, so a longer session has several, told
    apart by ``chunk_no``, which is part of the key; no separator stands between them.
    """
    out = (
        positioned.withColumn("chunk_no", F.floor(F.col("pos") / max_events))
        .groupBy("session_id", "chunk_no")
        .agg(
            F.sort_array(F.collect_list(F.struct("pos", "event"))).alias("items"),
            F.max("label").alias("label"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .withColumn("events", F.transform("items", lambda x: x["event"]))
        .drop("items")
    )
    if sep is not None:
        out = out.withColumn("text", F.array_join("events", sep)).drop("events")
    return out


def session_head(positioned: DataFrame, chars: int = 50, sep: str = " ") -> DataFrame:
    """First ``chars`` characters of the joined text of each session, from as many events as that can take."""
    first = positioned.filter((F.col("pos") <= chars) & F.col("event").isNotNull())
    items = F.sort_array(F.collect_list(F.struct("pos", "event")))
    joined = F.array_join(F.transform("items", lambda x: x["event"]), sep)
    return first.groupBy("session_id").agg(items.alias("items")).select("session_id", F.left(joined, F.lit(chars)).alias("head"))


def session_summary(events: DataFrame) -> DataFrame:
    """Start, end, count, last event, duration and error rows; needs no positions."""
    last = F.max(F.struct("ts", "tiebreak", "event"))
    out = events.groupBy("session_id").agg(
        F.max("label").alias("label"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum("label").alias("n_error_events"),
        last.alias("last"),
    )
    return out.select(
        "*",
        F.col("last.event").alias("last_event"),
        (minutes_between(F.col("end_ts"), F.col("start_ts")) * 60).alias("duration_sec"),
    ).drop("last")


def first_error(positioned: DataFrame) -> DataFrame:
    """First row labelled 1 of each session that has one."""
    return (
        positioned.filter("label = 1")
        .groupBy("session_id")
        .agg(F.min(F.struct("pos", "ts", "event")).alias("first"))
        .select(
            "session_id",
            F.col("first.pos").alias("first_error_pos"),
            F.col("first.ts").alias("first_error_ts"),
            F.col("first.event").alias("first_error_event"),
        )
    )


def split_long(positioned: DataFrame, max_logs: int = 500) -> DataFrame:
    """Cut sessions in consecutive sub-sessions; session identity is kept."""
    return positioned.withColumn("chunk_no", F.floor(F.col("pos") / max_logs)).withColumn(
        "chunk_pos", F.col("pos") % max_logs
    )


def count_windows(positioned: DataFrame, n: int = 20) -> DataFrame:
    """Number fixed, non-overlapping windows of ``n`` events per session."""
    return positioned.withColumn("window_no", F.floor(F.col("pos") / n)).withColumn("window_pos", F.col("pos") % n)


def windows_as_sessions(windowed: DataFrame) -> DataFrame:
    """Events with each count window as a session of its own."""
    key = F.concat_ws("#", F.col("session_id").cast("string"), F.col("window_no").cast("string"))
    return windowed.select(key.alias("session_id"), "ts", "tiebreak", "event", "label")


def window_table(windowed: DataFrame) -> DataFrame:
    """One row per count window: label by max, length, events in order."""
    return (
        windowed.groupBy("session_id", "window_no")
        .agg(
            F.max("label").alias("label"),
            F.count(F.lit(1)).alias("n_events"),
            F.sort_array(F.collect_list(F.struct("window_pos", "event"))).alias("items"),
        )
        .withColumn("events", F.transform("items", lambda x: x["event"]))
        .drop("items")
    )


def sliding_windows(positioned: DataFrame, n: int = 20, step: int = 1, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Overlapping full windows of ``n`` events that start every ``step`` events."""
    frame = chunk_window().rowsBetween(0, n - 1)
    out = with_halo(positioned, ahead=n - 1, chunk_rows=chunk_rows).withColumns(
        {"events": F.collect_list("event").over(frame), "window_label": F.max("label").over(frame)}
    )
    out = drop_halo(out).filter((F.col("pos") % step == 0) & (F.size("events") == n))
    return out.select("session_id", F.col("pos").alias("start_pos"), F.col("window_label").alias("label"), "events")


def clean_windows(windows: DataFrame) -> DataFrame:
    """Windows without an anomaly, for training."""
    return windows.filter("label = 0")


def pack_blocks(tokens: DataFrame, block: int, buckets: int) -> DataFrame:
    """Concatenate the tokens of the sessions of a bucket and cut equal blocks.

    ``tokens`` has (session_id, pos, token_id).  A bucket is the batch: sessions
    follow each other by id, and the remainder of a bucket is dropped.  Only the
    session lengths are ordered per bucket, never the tokens themselves.  Pass a
    stored table: it is read for the lengths and for the blocks.
    """
    lengths = tokens.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    lengths = lengths.withColumn("bucket", hash_bucket(F.col("session_id"), buckets))
    starts = running_totals(
        lengths, ["bucket"], ["session_id"], {"start": F.col("n_tokens")}, {"total": F.sum("n_tokens")}, small_bytes=SMALL_BYTES
    )
    placed = tokens.join(starts.select("session_id", "bucket", "start", "total"), "session_id")
    at = F.col("start") + F.col("pos")
    placed = placed.withColumns({"block_no": F.floor(at / block), "at": at % block})
    return (
        placed.filter((F.col("block_no") + 1) * block <= F.col("total"))
        .groupBy("bucket", "block_no")
        .agg(F.sort_array(F.collect_list(F.struct("at", "token_id"))).alias("items"))
        .select("bucket", "block_no", F.transform("items", lambda x: x["token_id"]).alias("tokens"))
    )


def hash_bucket(key: Column, buckets: int) -> Column:
    """Bucket of a key from md5, so that any engine can reproduce it."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def head_events(positioned: DataFrame, n: int = 1024) -> DataFrame:
    """First ``n`` events of each session."""
    return positioned.filter(F.col("pos") < n)


def with_context(positioned: DataFrame, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``context``: the last ``n`` events before each event."""
    frame = chunk_window().rowsBetween(-n, -1)
    out = with_halo(positioned, back=n, chunk_rows=chunk_rows)
    return drop_halo(out.withColumn("context", F.collect_list("event").over(frame)))


def with_previous(positioned: DataFrame, order: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``prev1`` .. ``prev<order>``, null before the session start."""
    if order == 0:
        return positioned
    out = with_halo(positioned, back=order, chunk_rows=chunk_rows)
    window = chunk_window()
    return drop_halo(out.withColumns({f"prev{i}": F.lag("event", i).over(window) for i in range(1, order + 1)}))


def order_check(events: DataFrame, ordinal: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sessions whose input order (by ``ordinal``) is not time order, with the number of steps back."""
    numbered = running_totals(events, ["session_id"], [ordinal], {"pos": F.lit(1)}, small_bytes=SMALL_BYTES)
    out = with_halo(numbered, back=1, chunk_rows=chunk_rows)
    out = drop_halo(out.withColumn("_before", F.lag("ts").over(chunk_window())))
    return (
        out.filter(F.col("_before") > F.col("ts")).groupBy("session_id").agg(F.count(F.lit(1)).alias("steps_back"))
    )


def event_counts(events: DataFrame, vocab: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of each event per session; wide with one column per ``vocab`` entry."""
    if vocab is None:
        return events.groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("cnt"))
    return events.groupBy("session_id").agg(
        *[F.count_if(F.col("event") == e).alias(e) for e in vocab]
    )


def gap_sessions(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Merge the events of a key into sessions broken by a pause longer than the gap.

    Events in one time slot no wider than the gap always belong together, so each
    slot is reduced before the shuffle and only slots are ordered per key.
    """
    slots = (
        events.withColumn("slot", F.expr(f"unix_micros(ts) div {gap_seconds * 1_000_000}"))
        .groupBy(key, "slot")
        .agg(
            F.min("ts").alias("lo"),
            F.max("ts").alias("hi"),
            F.count(F.lit(1)).alias("cnt"),
            F.max("label").alias("slot_label"),
        )
    )
    numbered = running_totals(slots, [key], ["slot"], {"pos": F.lit(1)}, small_bytes=SMALL_BYTES)
    halo = with_halo(numbered, back=1, keys=[key])
    halo = drop_halo(halo.withColumn("_hi", F.lag("hi").over(chunk_window([key]))))
    pause = F.unix_micros("lo") - F.unix_micros("_hi")
    opens = F.when(F.col("_hi").isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    marked = halo.withColumn("_opens", opens)
    marked = running_totals(marked, [key], ["slot"], {"_earlier": F.col("_opens")}, small_bytes=SMALL_BYTES)
    return (
        marked.withColumn("gap_no", F.col("_earlier") + F.col("_opens") - 1)
        .groupBy(key, "gap_no")
        .agg(
            F.min("lo").alias("start_ts"),
            F.max("hi").alias("end_ts"),
            F.sum("cnt").alias("n_events"),
            F.max("slot_label").alias("label"),
        )
    )
