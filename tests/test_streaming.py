"""The stream gives the batch detector's first alerts, in whatever order rows arrive."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import EVENTS
from vigilseq.operators import detect, model, sessions
from vigilseq.plans import logs
from vigilseq.sources.staging import stage
from vigilseq.streaming import first_alert

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def log_rows():
    out = []
    for s in range(12):
        for i in range(10):
            event = "abc"[i % 3] if not (s % 3 == 0 and i in (4, 7)) else "odd"
            out.append((f"s{s}", START + dt.timedelta(minutes=10 * i, seconds=s), i, event, int(event == "odd")))
    return out


STREAM = EVENTS + ", session_end timestamp"


@pytest.fixture
def session(spark):
    """A session of its own with the state store that the stream needs."""
    own = spark.newSession()
    own.conf.set(first_alert.PROVIDER, first_alert.ROCKSDB)
    return own


def ending(rows, days=30):
    return [(*r, START + dt.timedelta(days=days)) for r in rows]


@pytest.mark.parametrize("order", [1, 2])
def test_first_alerts_match_batch(spark, session, tmp_path, order):
    rows = log_rows()
    end = ("late", START + dt.timedelta(days=2), 0, "a", 0)  # moves the watermark past all other rows
    batch = spark.createDataFrame(rows, EVENTS)
    contexts = sessions.with_previous(sessions.sessionize(batch), order)
    ngrams = stage(model.fit_next_event(contexts.filter("session_label = 0"), order))
    scored = model.score_events(contexts, ngrams, order, skip=3)
    wanted = detect.detect_threshold(scored, 2.0, 3).filter("predicted = 1")
    wanted = sorted((r["session_id"], r["alert_pos"], r["alert_event"]) for r in wanted.collect())
    assert len(wanted) == 4

    source, result = str(tmp_path / "in"), str(tmp_path / "out")
    times = sorted({r[1] for r in rows})
    early = [r for r in rows if r[1] < times[len(times) // 2]]
    rest = [r for r in rows if r not in early]
    for part in (list(reversed(early)), rest[::2] + rest[1::2], [end]):
        spark.createDataFrame(ending(part), STREAM).coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema(STREAM).parquet(source)
        query = first_alert.stream_first_alert(
            stream, ngrams, 2.0, result, order=order, skip=3, watermark="30 minutes", availableNow=True
        )
        query.awaitTermination()
    found = first_alert.read_first_alerts(spark, result)
    assert sorted((r["session_id"], r["pos"], r["event"]) for r in found.collect()) == wanted


def test_rows_leave_in_order_with_context(spark, session, tmp_path):
    rows = log_rows()[:10]
    source = str(tmp_path / "in")
    end = ("late", START + dt.timedelta(days=2), 0, "a", 0)
    spark.createDataFrame(ending(list(reversed(rows)) + [end]), STREAM).coalesce(1).write.parquet(source)
    contexts = first_alert.stream_contexts(session.readStream.schema(STREAM).parquet(source), 2, "30 minutes")
    query = contexts.writeStream.format("memory").queryName("ordered").trigger(availableNow=True).start()
    query.awaitTermination()
    found = [r for r in session.table("ordered").filter(F.col("session_id") == "s0").orderBy("pos").collect()]
    events = [r[3] for r in rows]
    assert [r["event"] for r in found] == events
    assert [r["prev2"] for r in found] == [None, None, *events[:-2]]


def test_a_long_pause_does_not_restart_a_session(spark, session, tmp_path):
    """One micro-batch per row, pauses of days: positions and contexts go on until the session's end."""
    source, events = str(tmp_path / "in"), ["a", "b", "c", "d"]
    for i, event in enumerate(events):
        row = ("s", START + dt.timedelta(days=5 * i), i, event, 0)
        spark.createDataFrame(ending([row]), STREAM).coalesce(1).write.mode("append").parquet(source)
    end = ("late", START + dt.timedelta(days=60), 0, "a", 0)
    spark.createDataFrame(ending([end], 90), STREAM).coalesce(1).write.mode("append").parquet(source)
    stream = session.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(source)
    contexts = first_alert.stream_contexts(stream, 1, "1 hour")
    query = contexts.writeStream.format("memory").queryName("paused").trigger(availableNow=True).start()
    query.awaitTermination()
    found = session.table("paused").filter("session_id = 's'").orderBy("pos").collect()
    assert [(r["pos"], r["event"], r["prev1"]) for r in found] == [(0, "a", None), (1, "b", "a"), (2, "c", "b"), (3, "d", "c")]


def test_the_state_store_is_asked_for(spark, session):
    stream = spark.readStream.format("rate").load().selectExpr(
        "cast(value as string) session_id", "timestamp ts", "value tiebreak", "'a' event", "timestamp session_end"
    )
    with pytest.raises(ValueError):
        first_alert.stream_contexts(stream, 1, "1 hour")


def test_sessions_with_late_rows_are_reconciled(spark, session, tmp_path):
    """Rows behind the watermark leave the stream's result; all are counted, and their sessions are scored again."""
    rows = log_rows()
    batch = spark.createDataFrame(rows, EVENTS)
    contexts = sessions.with_previous(sessions.sessionize(batch), 1)
    ngrams = stage(model.fit_next_event(contexts.filter("session_label = 0"), 1))
    wanted = detect.detect_threshold(model.score_events(contexts, ngrams, 1, skip=3), 2.0, 3).filter("predicted = 1")
    wanted = sorted((r["session_id"], r["alert_pos"], r["alert_event"]) for r in wanted.collect())

    source, result = str(tmp_path / "in"), str(tmp_path / "out")
    late = [r for r in rows if r[0] in ("s0", "s1") and r[2] in (1, 4)]
    parts = [[r for r in rows if r not in late and r[2] < 8], [r for r in rows if r[2] >= 8], late, [("end", START + dt.timedelta(days=2), 0, "a", 0)]]
    for part in parts:
        spark.createDataFrame(ending(part, 1), STREAM).coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema(STREAM).parquet(source)
        query = first_alert.stream_first_alert(stream, ngrams, 2.0, result, skip=3, watermark="1 minute", availableNow=True)
        query.awaitTermination()
    log = spark.createDataFrame(ending(rows, 1), STREAM)
    until = START + dt.timedelta(days=1)
    counts = first_alert.late_rows(spark, result, log, until)
    assert sorted(map(tuple, counts.collect())) == [("s0", 10, 2), ("s1", 10, 2)]
    raw = sorted((r["session_id"], r["pos"], r["event"]) for r in first_alert.read_first_alerts(spark, result).collect())
    found = first_alert.reconciled_alerts(spark, result, log, until, ngrams, 2.0, skip=3)
    assert sorted((r["session_id"], r["pos"], r["event"]) for r in found.collect()) == wanted != raw


class Store:
    """State of one group in memory, which counts the exchanges with it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Value(self)

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]

    def registerTimer(self, timer):
        self.calls += 1
        self.timers.add(timer)

    def deleteTimer(self, timer):
        self.calls += 1
        self.timers.discard(timer)


class Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls += 1
        self.store.value = value

    def clear(self):
        self.store.calls += 1
        self.store.value = None


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def minutes(n):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=n)


def test_a_call_exchanges_little_with_the_state_store():
    """Many sessions with rows minutes apart: exchanges do not grow with rows or sessions."""
    store, steps = Store(), first_alert.InOrder(2)
    steps.init(store)
    rows = [(f"s{i % 50}", minutes(i), i, f"e{i}", minutes(1000)) for i in range(500)]
    pdf = pd.DataFrame(rows, columns=first_alert.STREAM_COLUMNS)
    assert list(steps.handleInputRows((0,), iter([pdf]), Mark(0))) == []
    (out,) = steps.handleExpiredTimer((0,), Mark(minutes(400).value // 10**6), None)
    assert len(out) == 400 and store.calls < 20
    assert out[out.session_id == "s7"]["prev2"].tolist() == [None, None, *[f"e{i}" for i in range(7, 307, 50)]]


@pytest.mark.parametrize("piece_rows", [1, 7, 4096])
def test_pieces_of_waiting_rows_give_every_row_once_in_order(monkeypatch, piece_rows):
    monkeypatch.setattr(first_alert, "PIECE_ROWS", piece_rows)
    store, steps, found = Store(), first_alert.InOrder(1), []
    steps.init(store)
    wanted = [(f"s{i % 9}", minutes(i * 37 % 300), i, f"e{i}", minutes(200 + 40 * (i % 9))) for i in range(300)]
    marks = [minutes(m).value // 10**6 for m in range(-60, 700, 30)]
    for n, mark in enumerate(marks):
        now = minutes(30 * n)
        part = [r for r in wanted if now <= r[1] + pd.Timedelta(minutes=r[2] % 60) < now + pd.Timedelta(minutes=30)]
        if part:
            pdf = pd.DataFrame(part, columns=first_alert.STREAM_COLUMNS)
            found += steps.handleInputRows((0,), iter([pdf]), Mark(mark))
        for timer in [t for t in store.timers if t <= mark]:
            found += steps.handleExpiredTimer((0,), Mark(mark), None)
            store.deleteTimer(timer)
        assert all(len(piece[0]) <= piece_rows for piece in store.map.values())
    out = pd.concat(found)
    for s in range(9):
        own = sorted((r for r in wanted if r[0] == f"s{s}"), key=lambda r: (r[1], r[2]))
        got = out[out.session_id == f"s{s}"]
        assert got["pos"].tolist() == list(range(len(own))) and got["event"].tolist() == [r[3] for r in own]
        assert got["prev1"].tolist() == [None, *[r[3] for r in own[:-1]]]
    assert store.value is None and not store.map and not store.timers


def test_batches_of_a_large_log_have_more_files(spark, tmp_path, monkeypatch):
    """All rows once, in as many files a batch as its rows need, which the stream takes together."""
    monkeypatch.setattr(logs, "FILE_ROWS", 100)
    rows = [(f"s{i % 40}", START + dt.timedelta(minutes=i), i, "a", 0) for i in range(1400)]
    stream, _ = logs.live_files(spark, spark.createDataFrame(rows, EVENTS), str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    assert stored.count() == 1401 and len(stored.inputFiles()) == 8 * 4 + 1
    query = stream.writeStream.format("memory").queryName("large").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("large").count() == 1401 and len([p for p in query.recentProgress if p["numInputRows"]]) == 9
