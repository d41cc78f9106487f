"""First alert per session on a live event stream.

The stateful step only restores event order: rows of a session wait until the
watermark has passed them and leave with their position and the events before
them.  Its state is kept per group of sessions, dealt by hash, so that a call and
its exchanges with the state store serve many rows; a timer set to the first
waiting row wakes it.  Scoring is the batch operator, applied to each micro-batch, so the
model may be of any size; the sink keeps the first alert of a session.

A session lasts until the time in its ``session_end`` column, however long it
pauses; its part of the state is dropped when the watermark passes that time.  The batch
detector has no notion of pauses either, so both give the same alerts.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilseq.operators.model import ModelSize, score_events
from vigilseq.operators.sessions import sessionize_with_previous
from vigilseq.sources.staging import stage

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = 1024  # of sessions that share a state; up to a thousand open sessions in each are a good size
PIECE_ROWS = 4096  # most waiting rows that are stored together
FAR = 1 << 62
STREAM_COLUMNS = ["session_id", "ts", "tiebreak", "event", "session_end"]


def _context_schema(order: int) -> str:
    previous = "".join(f", prev{i} string" for i in range(1, order + 1))
    return f"session_id string, pos bigint, ts timestamp, event string{previous}"


class InOrder(StatefulProcessor):
    """Rows of a group of sessions in time order, each with its position and the ``order`` events before in its session.

    Waiting rows are kept in pieces of up to ``PIECE_ROWS`` in time order.  A micro-batch adds
    pieces with its own rows and reads only the pieces whose first row the watermark has passed;
    what still waits of those is written as new pieces.
    """

    def __init__(self, order: int) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = "session array<string>, micros array<bigint>, tie array<bigint>, event array<string>"
        self.waiting = handle.getMapState("waiting", "piece bigint", waiting)
        sessions = "session array<string>, pos array<bigint>, ends array<bigint>, recent array<array<string>>"
        self.open = handle.getValueState("open", f"{sessions}, piece array<bigint>, low array<bigint>, timer bigint")

    def _group(self) -> tuple[dict[str, tuple[int, int, list[str]]], dict[int, int], int | None]:
        """Position, end and last events of the sessions; lowest time in each piece; timer."""
        stored = self.open.get()
        if stored is None:
            return {}, {}, None
        names, pos, ends, recent, pieces, lows, timer = stored
        return dict(zip(names, zip(pos, ends, map(list, recent)))), dict(zip(pieces, lows)), timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions, pieces, timer = self._group()
        new = []
        for pdf in rows:
            micros = pdf["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            until = (pdf["session_end"].to_numpy("datetime64[us]").astype("int64") // 1000).tolist()
            new += zip(pdf["session_id"].tolist(), micros, pdf["tiebreak"].tolist(), pdf["event"].tolist())
            for session, at, last in zip(pdf["session_id"].tolist(), micros, until):
                pos, ends, recent = sessions.get(session) or (0, last, [])
                sessions[session] = pos, max(ends, last, at // 1000), recent
        yield from self._leave(timerValues.getCurrentWatermarkInMs(), sessions, pieces, timer, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions, pieces, timer = self._group()
        if sessions or pieces:  # rows of the same micro-batch may have ended all sessions before
            yield from self._leave(timerValues.getCurrentWatermarkInMs(), sessions, pieces, timer, [])

    def _leave(
        self, mark: int, sessions: dict[str, tuple[int, int, list[str]]], pieces: dict[int, int], timer: int | None, rows: list[tuple[str, int, int, str]]
    ) -> Iterator[pd.DataFrame]:
        """Emit what the watermark has passed; forget ended sessions; set the next timer."""
        following = max(pieces, default=-1) + 1
        for piece in [p for p, low in pieces.items() if low // 1000 < mark]:
            rows += zip(*self.waiting.getValue((piece,)))
            self.waiting.removeKey((piece,))
            del pieces[piece]
        due, rest = {}, []
        for row in rows:
            if row[1] // 1000 < mark:
                due.setdefault(row[0], []).append(row[1:])
            else:
                rest.append(row)
        rest.sort(key=lambda row: row[1])
        for piece, at in enumerate(range(0, len(rest), PIECE_ROWS), following):
            self.waiting.updateValue((piece,), tuple(map(list, zip(*rest[at : at + PIECE_ROWS]))))
            pieces[piece] = rest[at][1]
        out = []
        for session, own in due.items():
            pos, ends, recent = sessions[session]
            for micros, _, event in sorted(own):
                out.append((session, pos, micros, event, *[recent[-i] if len(recent) >= i else None for i in range(1, self.order + 1)]))
                pos, recent = pos + 1, (recent + [event])[-self.order :] if self.order else []
            sessions[session] = pos, ends, recent
        sessions = {session: state for session, state in sessions.items() if state[1] >= mark}
        wake = max(min([*pieces.values()], default=FAR) // 1000, mark) + 1
        wake = min([wake, *(ends + 1 for _, ends, _ in sessions.values())])
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if sessions:  # a session with waiting rows has not ended
            pos, ends, recent = zip(*sessions.values())
            self.open.update((list(sessions), list(pos), list(ends), list(recent), list(pieces), list(pieces.values()), wake))
            if timer != wake:
                self.handle.registerTimer(wake)
        else:
            self.open.clear()
        if out:
            pdf = pd.DataFrame(out, columns=["session_id", "pos", "ts", "event", *[f"prev{i}" for i in range(1, self.order + 1)]])
            pdf["ts"] = pd.to_datetime(pdf["ts"], unit="us")
            yield pdf

    def close(self) -> None:
        pass


def stream_contexts(stream: DataFrame, order: int, watermark: str, groups: int = GROUPS) -> DataFrame:
    """Events (session_id, ts, tiebreak, event, session_end) in time order with ``pos`` and ``prev*``."""
    if stream.sparkSession.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    rows = stream.select(
        F.col("session_id").cast("string").alias("session_id"),
        "ts",
        "tiebreak",
        F.coalesce("event", F.lit("")).alias("event"),
        "session_end",
    )
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("session_id"), F.lit(groups)))
    return (
        rows.withWatermark("ts", watermark)
        .groupBy("_group")
        .transformWithStateInPandas(InOrder(order), _context_schema(order), "Append", "EventTime")
    )


def stream_first_alert(
    stream: DataFrame,
    ngrams: DataFrame,
    threshold: float,
    path: str,
    order: int = 1,
    k: int = 5,
    skip: int = 3,
    watermark: str = "1 hour",
    groups: int = GROUPS,
    **trigger,
) -> StreamingQuery:
    """Start the detector; alerts go to ``path``, one folder per micro-batch.

    A repeated micro-batch overwrites its own folder, so alerts are written once.
    Pass a saved model.  Read the result with ``read_first_alerts``.
    """
    contexts = stream_contexts(stream, order, watermark, groups)
    size = ModelSize.of(ngrams)  # once; the model does not change while the stream runs

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # a large model is joined to its patterns and to its rows
        batch.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/left/batch={batch_id}")
        scored = score_events(batch, ngrams, order, k, skip, size=size)
        alerts = scored.filter((F.col("loss") > threshold) & (F.col("pos") >= skip))
        first = alerts.groupBy("session_id").agg(F.min(F.struct("pos", "ts", "event", "loss")).alias("alert"))
        first.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        batch.unpersist()

    return (
        contexts.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_first_alerts(spark: SparkSession, path: str) -> DataFrame:
    """First alert of each session over all micro-batches."""
    schema = "session_id string, alert struct<pos bigint, ts timestamp, event string, loss double>, batch bigint"
    alerts = spark.read.schema(schema).parquet(f"{path}/alerts")
    return alerts.groupBy("session_id").agg(F.min("alert").alias("alert")).select("session_id", "alert.*")


def late_rows(spark: SparkSession, path: str, log: DataFrame, until: dt.datetime) -> DataFrame:
    """(session_id, n_rows, n_late) of the sessions ended by ``until`` of which rows came behind the watermark.

    ``log`` is the stream's input as a table.  The stream drops such rows; it writes how many
    rows of each session left it, so the rest are late and none is unaccounted for.
    """
    left = spark.read.schema("session_id string, n bigint").parquet(f"{path}/left/*").groupBy("session_id").agg(F.sum("n").alias("n"))
    ended = log.filter(F.col("session_end") <= F.lit(until)).groupBy(F.col("session_id").cast("string").alias("session_id"))
    counts = ended.agg(F.count(F.lit(1)).alias("n_rows")).join(left, "session_id", "left")
    late = counts.withColumn("n_late", F.col("n_rows") - F.coalesce("n", F.lit(0)))
    return late.filter("n_late > 0").select("session_id", "n_rows", "n_late")


def reconciled_alerts(
    spark: SparkSession, path: str, log: DataFrame, until: dt.datetime, ngrams: DataFrame, threshold: float, order: int = 1, k: int = 5, skip: int = 3
) -> DataFrame:
    """First alerts of all sessions, those with late rows scored again from the whole ``log``."""
    affected = stage(late_rows(spark, path, log, until).select("session_id"), "late")
    rows = log.withColumn("session_id", F.col("session_id").cast("string")).join(affected, "session_id", "left_semi")
    rows = rows.select("session_id", "ts", "tiebreak", F.coalesce("event", F.lit("")).alias("event"), F.lit(0).alias("label"))
    scored = score_events(sessionize_with_previous(rows, order), ngrams, order, k, skip)
    alerts = scored.filter((F.col("loss") > threshold) & (F.col("pos") >= skip))
    again = alerts.groupBy("session_id").agg(F.min(F.struct("pos", "ts", "event", "loss")).alias("alert")).select("session_id", "alert.*")
    return read_first_alerts(spark, path).join(affected, "session_id", "left_anti").unionByName(again)
