import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from vigilseq.operators import detect, model, sessions
from vigilseq.plans import detection
from vigilseq.sources.staging import stage
from vigilseq.sources.tables import load_model, save_model


def contexts(log, order):
    return sessions.with_previous(sessions.sessionize(log), order)


@pytest.fixture
def log(events):
    rows = [(s, i, "abcab"[(i * (s % 3 + 1) + s) % 5], 0) for s in range(12) for i in range(3 + s)]
    return events(rows)


def brute_force(log, order, k, skip, min_ctx):
    """Score by walking plain lists."""
    lists = defaultdict(list)
    for r in sorted(log.collect(), key=lambda r: (r["ts"], r["tiebreak"])):
        lists[r["session_id"]].append(r["event"])
    nexts = defaultdict(Counter)
    for seq in lists.values():
        for i, e in enumerate(seq):
            for o in range(min(order, i) + 1):
                nexts[tuple(seq[i - o : i])][e] += 1
    size = len(nexts[()]) + 1
    out = {}
    for s, seq in lists.items():
        for i, e in enumerate(seq):
            if i < max(1, skip):
                out[s, i] = (None, None)
                continue
            o = max(o for o in range(min(order, i) + 1) if o == 0 or sum(nexts.get(tuple(seq[i - o : i]), {}).values()) >= min_ctx)
            seen = nexts[tuple(seq[i - o : i])]
            top = [x for x, _ in sorted(seen.items(), key=lambda p: (-p[1], p[0]))[:k]]
            out[s, i] = (-math.log((seen[e] + 1) / (sum(seen.values()) + size)), e in top)
    return out


@pytest.mark.parametrize("order, min_ctx", [(0, 1), (1, 1), (2, 6), (3, 9)])
@pytest.mark.parametrize("limit", [model.BROADCAST_BYTES, 0])
def test_scores_match_brute_force(log, order, min_ctx, limit):
    rows = contexts(log, order)
    ngrams = stage(model.fit_next_event(rows, order))
    scored = model.score_events(rows, ngrams, order, k=2, min_ctx=min_ctx, broadcast_bytes=limit)
    wanted = brute_force(log, order, 2, 1, min_ctx)
    found = {(r["session_id"], r["pos"]): (r["loss"], r["in_topk"]) for r in scored.collect()}
    assert found.keys() == wanted.keys()
    for key, (loss, top) in wanted.items():
        assert found[key] == (None if loss is None else pytest.approx(loss), top)


def test_ties_take_the_smaller_event(events):
    rows = contexts(events([(1, 0, "a", 0), (1, 1, "z", 0), (2, 0, "a", 0), (2, 1, "b", 0)]), 1)
    top = model.topk_next(model.fit_next_event(rows, 1).drop("rank"), 1).filter("order = 1")
    assert [r["next"] for r in top.collect()] == ["b"]


def test_unknown_event_is_a_miss_with_the_floor_loss(events):
    train = events([(1, i, e, 0) for i, e in enumerate("abab")])
    ngrams = stage(model.fit_next_event(contexts(train, 1), 1))
    test = contexts(events([(2, 0, "a", 0), (2, 1, "never", 1)]), 1)
    row = model.score_events(test, ngrams, 1).filter("pos = 1").first()
    assert row["in_topk"] is False
    assert row["loss"] == pytest.approx(-math.log(1 / (2 + 3)))  # two successors of a; a, b and unknown


def test_model_counts_do_not_cross_sessions(events):
    rows = contexts(events([(1, 0, "a", 0), (1, 1, "b", 0), (2, 2, "c", 0), (2, 3, "d", 0)]), 1)
    pairs = model.fit_next_event(rows, 1).filter("order = 1").select("ctx", "next")
    assert rows_of(pairs) == [("a", "b"), ("c", "d")]


def test_saved_model(spark, log, tmp_path):
    ngrams = model.fit_next_event(contexts(log, 2), 2)
    save_model(ngrams, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model")).select(ngrams.columns)
    assert sorted(map(str, loaded.collect())) == sorted(map(str, ngrams.collect()))


def scored_table(spark, losses):
    """Scored rows of one session from (loss, in_topk, label)."""
    data = [("s", i, i, f"e{i}", lb, loss, top, 1) for i, (loss, top, lb) in enumerate(losses)]
    schema = "session_id string, pos long, sec long, event string, label int, loss double, in_topk boolean, session_label int"
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("sec"))


def test_first_alert_position_and_step(spark):
    row = detect.detect_topk(scored_table(spark, [(None, None, 0), (1.0, True, 0), (2.0, False, 0), (3.0, False, 1)])).first()
    assert (row["predicted"], row["alert_pos"], row["first_anomaly_step"], row["first_error_pos"]) == (1, 2, 1, 3)
    quiet = detect.detect_topk(scored_table(spark, [(None, None, 0), (1.0, True, 0)])).first()
    assert (quiet["predicted"], quiet["first_anomaly_step"], quiet["alert_loss"]) == (0, -1, 0.0)


def test_threshold_is_strict_and_keeps_the_uncensored_loss(spark):
    table = scored_table(spark, [(None, None, 0)] * 3 + [(2.0, True, 0), (2.5, True, 0), (9.0, True, 1)])
    at = detect.detect_threshold(table, 2.5).first()
    assert (at["alert_pos"], at["alert_loss"], at["max_loss"]) == (5, 9.0, 9.0)
    below = detect.detect_threshold(table, 9.0).first()
    assert (below["predicted"], below["alert_loss"], below["max_loss"]) == (0, 0.0, 9.0)


def test_short_sessions_cannot_alert(spark):
    found = detect.detect_threshold(scored_table(spark, [(9.0, False, 0)] * 3), 1.0)
    assert found.first()["predicted"] == 0
    assert detect.unscorable(found).first()["n_unscorable"] == 1


def test_alerts_shrink_as_k_and_threshold_grow(log):
    rows = contexts(log, 1)
    ngrams = stage(model.fit_next_event(rows, 1))
    flagged = [
        {r["session_id"] for r in detect.detect_topk(model.score_events(rows, ngrams, k=k)).filter("predicted = 1").collect()}
        for k in (1, 2, 3)
    ]
    assert flagged[0] >= flagged[1] >= flagged[2]
    scored = stage(model.score_events(rows, ngrams))
    counts = [detect.detect_threshold(scored, t, 1).filter("predicted = 1").count() for t in (0.0, 0.5, 1.0, 2.0)]
    assert counts == sorted(counts, reverse=True)


def test_training_scope(events):
    rows = [(s, i, e, 0) for s in range(40) for i, e in enumerate("ab")] + [(99, 0, "a", 0), (99, 1, "q", 0), (99, 2, "x", 1)]
    contexts = detection.stored_contexts(events(rows))
    by_session = {r["next"] for r in detection.fit(contexts).collect()}
    by_row = {r["next"] for r in detection.fit(contexts, normal_scope="row").collect()}
    assert by_session == {"a", "b"} and by_row == {"a", "b", "q"}


def test_detection_does_not_depend_on_partitioning(spark, events):
    rows = [(s, i, "abcd"[(s * i + i) % 4] if s % 7 else "abcx"[i % 4], int(s % 7 == 0 and i % 4 == 3)) for s in range(60) for i in range(8)]
    log = events(rows)
    one = detection.topk_detections(log, 1, 2)
    two = detection.topk_detections(log.repartition(9), 1, 2)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_detection_does_not_depend_on_the_pieces(events, spark):
    rows = [("hot", i, f"e{i * 7 % 5}", int(i == 350)) for i in range(400)]
    rows += [(f"s{i % 30}", i, f"e{i % 4}", 0) for i in range(240)]
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for pieces in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
        found.append(detection.topk_detections(events(rows), 2, 1))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
    assert found[0].filter("session_id = 'hot'").first()["n_events"] == 400


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fitting_reads_only_the_training_files(log):
    plan = plan_of(model.fit_next_event(detection.train_rows(detection.stored_contexts(log)), 1))
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "tiebreak" not in plan and "n_events" not in plan


def test_ranks_are_limited_before_the_shuffle(log):
    counts = stage(model.fit_next_event(contexts(log, 1), 1).drop("rank"))
    assert plan_of(model.topk_next(counts, 3)).count("WindowGroupLimit") == 2


def test_small_models_leave_the_rows_in_place(log):
    stored = detection.stored_contexts(log)
    scored = model.score_events(stored.filter("split = 'test'"), detection.fit(stored), 1)
    plan = plan_of(scored)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3


def test_hybrid(spark, events):
    log = events([("s", 0, "a", 0), ("s", 1, "rare", 0), ("t", 0, "error", 1), ("u", 0, "a", 0)])
    found = spark.createDataFrame([("s", 0, 0, 2), ("t", 1, 0, 1), ("u", 0, 0, 1)], "session_id string, label int, predicted int, n_events long")
    rare = spark.createDataFrame([("rare",)], "event string")
    out = detect.hybrid_detect(found, log, rare, [("^error", "error")])
    assert rows_of(out.select("session_id", "rare_hit", "rule_hit", "predicted")) == [("s", 1, 0, 1), ("t", 0, 1, 1), ("u", 0, 0, 0)]
