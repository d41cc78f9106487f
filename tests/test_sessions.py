from pyspark.sql import functions as F

from tests.conftest import LATE_ERROR, NORMAL, rows_of
from vigilseq.operators import detect, sessions, splits, vocab


def test_label_is_the_highest_of_all_rows(mixed):
    assert rows_of(sessions.session_labels(mixed)) == [("1", 1), ("2", 0), ("3", 1)]


def test_first_error(mixed):
    found = sessions.first_error(sessions.with_position(mixed))
    assert rows_of(found.select("session_id", "first_error_pos", "first_error_event")) == [("1", 2, "E9"), ("3", 1, "E9")]


def test_summary(mixed):
    row = sessions.session_summary(mixed).filter("session_id = '1'").first()
    assert (row["n_events"], row["n_error_events"], row["last_event"], row["duration_sec"]) == (4, 1, "E2", 60.0)


def test_equal_times_follow_the_tiebreak(events):
    log = events([(1, 5, e, 0) for e in "CAB"])
    for parts in (1, 3):
        found = sessions.session_sequences(sessions.with_position(log.repartition(parts)), max_events=100)
        assert found.first()["events"] == ["C", "A", "B"]


def test_long_sessions_keep_their_identity(events):
    log = sessions.with_position(events([(1, i, "e", 0) for i in range(1203)]))
    sizes = sessions.split_long(log).groupBy("session_id", "chunk_no").count()
    assert rows_of(sizes) == [("1", 0, 500), ("1", 1, 500), ("1", 2, 203)]
    whole = sessions.session_sequences(log, max_events=500)
    assert rows_of(whole.select("chunk_no", F.size("events"))) == [(0, 500), (1, 500), (2, 203)]


def test_windows(events):
    log = sessions.with_position(events([(1, i, f"e{i}", int(i == 25)) for i in range(45)]))
    table = sessions.window_table(sessions.count_windows(log, 20))
    assert rows_of(table.select("window_no", "label", "n_events")) == [(0, 0, 20), (1, 1, 20), (2, 0, 5)]
    assert sessions.clean_windows(table).count() == 2


def test_joined_text(events):
    text = sessions.session_sequences(sessions.with_position(events(NORMAL)), " \n ", max_events=100).first()["text"]
    assert text == "E1 \n E2 \n E2 \n E5"


def test_head_of_the_text(events):
    log = sessions.with_position(events([(1, i, "", 0) for i in range(80)] + [(2, 0, "ab", 0), (2, 1, "cd", 0)]))
    assert rows_of(sessions.session_head(log)) == [("1", " " * 50), ("2", "ab cd")]


def test_windows_as_sessions(events):
    log = sessions.with_position(events([(1, i, "e", 0) for i in range(45)]))
    cut = sessions.windows_as_sessions(sessions.count_windows(log, 20))
    assert rows_of(cut.groupBy("session_id").count()) == [("1#0", 20), ("1#1", 20), ("1#2", 5)]


def test_pack_blocks_drop_only_the_remainder(events):
    log = events([(s, i, f"e{i}", 0) for s in range(7) for i in range(5)])
    known = vocab.fit_vocab(log)
    blocks = sessions.pack_blocks(vocab.encode(sessions.with_position(log), known), 4, 1)
    tokens = [t for r in sorted(blocks.collect(), key=lambda r: r["block_no"]) for t in r["tokens"]]
    assert tokens == ([3, 4, 5, 6, 7] * 7)[:32]


def test_context(events):
    log = sessions.with_position(events(LATE_ERROR))
    found = sessions.with_context(log, 2).orderBy("pos").collect()
    assert [r["context"] for r in found] == [[], ["E1"], ["E1", "E2"], ["E2", "E9"]]


def test_order_check(events):
    log = events([(1, 0, "a", 0), (1, 9, "b", 0), (1, 4, "c", 0), (2, 1, "a", 0), (2, 2, "b", 0)])
    assert rows_of(sessions.order_check(log, "tiebreak")) == [("1", 1)]


def test_gap_sessions(events):
    log = events([("b", t, "e", 0) for t in (0, 50, 110, 111, 171, 172, 300)] + [("c", 5, "e", 1)])
    found = sessions.gap_sessions(log, "session_id", 60)
    assert rows_of(found.select("session_id", "gap_no", "n_events", "label")) == [("b", 0, 6, 0), ("b", 1, 1, 0), ("c", 0, 1, 1)]


def test_event_counts(mixed):
    assert ("2", "E2", 2) in rows_of(sessions.event_counts(mixed))
    wide = sessions.event_counts(mixed, ["E1", "E2"]).select("session_id", "E1", "E2")
    assert rows_of(wide) == [("1", 1, 2), ("2", 1, 2), ("3", 1, 0)]


def test_vocabulary_round_trip(events):
    train = events([(1, 0, "E2", 0), (1, 1, "E1", 0), (1, 2, "E3", 0), (1, 3, "E0", 1), (1, 4, None, 0)])
    known = vocab.fit_vocab(train)
    assert rows_of(known) == [("E1", 3), ("E2", 4), ("E3", 5)]
    assert rows_of(vocab.fit_vocab(train)) == rows_of(known)
    sample = sessions.sessionize(events([(9, i, e, 0) for i, e in enumerate(["E1", "E2", "E3", "NEVER_SEEN_EVENT"])]))
    plain = vocab.encode(sample, known)
    assert rows_of(plain) == [("9", 0, 3), ("9", 1, 4), ("9", 2, 5), ("9", 3, 1)]
    assert [r["event"] for r in vocab.decode(plain, known).orderBy("pos").collect()] == ["E1", "E2", "E3", "<UNK>"]
    assert [r["token_id"] for r in vocab.encode(sample, known, add_sep=True).orderBy("pos").collect()] == [3, 2, 4, 2, 5, 2, 1]


def test_overlap_and_unseen(mixed):
    assert vocab.vocab_overlap(mixed).first() == (3, 1, 0)
    found = detect.unseen_event_alert(mixed, vocab.fit_vocab(mixed)).select("session_id", "n_unseen")
    assert rows_of(found) == [("1", 1), ("3", 1)]


def test_splits_are_disjoint_and_stable(spark):
    every = spark.range(3000).select(F.col("id").alias("session_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    named = splits.split_normal(every)
    assert rows_of(named) == rows_of(splits.split_normal(every.repartition(7)))
    shares = {r["split"]: r["count"] / 2250 for r in named.filter("label = 0").groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["val"] - 0.1) < 0.03
    assert named.filter("label = 1 and split <> 'test'").count() == 0
    assert splits.leakage_audit(named).count() == 0
    assert splits.leakage_audit(named.unionByName(splits.split_normal(every, seed="other"))).count() > 0


def test_test_set(mixed):
    named = splits.split_normal(sessions.session_labels(mixed), cuts=(0, 0))
    assert splits.test_set(mixed, named).count() == mixed.count()
    kept = splits.test_set(mixed, splits.split_normal(sessions.session_labels(mixed), cuts=(100, 100)))
    assert {r["session_id"] for r in kept.collect()} == {"1", "3"}


def test_split_by_time(mixed):
    every = sessions.session_summary(mixed)
    assert {r["split"] for r in splits.split_by_time(every, "2024-01-02").collect()} == {"train"}
    assert {r["split"] for r in splits.split_by_share(every, 0.0).collect()} == {"test"}
