import math
from collections import Counter

import pytest

from vigilseq.operators import sessions, token_model
from vigilseq.operators.model import count_grams, fit_next_event, rank_grams, score_events, update_model
from vigilseq.plans import detection

LOG = [
    ("a", 0, "open file one", 0), ("a", 1, None, 0), ("a", 2, "close  file one", 0), ("a", 3, "open file two now please", 0),
    ("b", 0, "", 0), ("b", 1, "open file one", 0), ("b", 2, "close file two", 0), ("c", 0, "x", 0),
]


def plain_tokens(rows):
    """Per session the tokens of each event."""
    found = {}
    for s, _, event, _ in rows:
        own = found.setdefault(s, [])
        own.append((["\n"] if own else []) + (event or "").split())
    return found


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_contexts_cross_event_borders(spark, events, order):
    rows = token_model.token_rows(sessions.sessionize_with_previous(events(LOG), order), order)
    got = sorted((r["session_id"], r["pos"], r["sub"], r["event"], *[r[f"prev{i}"] for i in range(1, order + 1)]) for r in rows.filter("event is not null").collect())
    wanted = []
    for session, own in plain_tokens(LOG).items():
        flat = [t for tokens in own for t in tokens]
        at = 0
        for pos, tokens in enumerate(own):
            for sub, token in enumerate(tokens):
                wanted.append((session, pos, sub, token, *[flat[at - i] if at >= i else None for i in range(1, order + 1)]))
                at += 1
    assert got == sorted(wanted)
    assert rows.select("session_id", "pos").distinct().count() == len(LOG)


def test_loss_is_the_mean_over_the_tokens(spark, events):
    contexts = sessions.sessionize_with_previous(events(LOG), 1)
    tokens = token_model.token_rows(contexts, 1)
    ngrams = fit_next_event(tokens.filter("event is not null"), 1)
    found = token_model.event_loss(score_events(tokens, ngrams, 1, skip=1), max_tokens=6)
    flat = [[t for own in tokens for t in own] for tokens in plain_tokens(LOG).values()]
    pairs = Counter(p for own in flat for p in zip(own, own[1:]))
    after = Counter(p for own in flat for p in own[:-1])
    vocab = len({t for own in flat for t in own}) + 1
    got = {(r["session_id"], r["pos"]): r for r in found.collect()}
    assert set(got) == {(s, p) for s, own in plain_tokens(LOG).items() for p in range(len(own))}
    for session, own in plain_tokens(LOG).items():
        for pos, tokens in enumerate(own):
            row = got[session, pos]
            assert row["n_tokens"] == len(tokens) and row["n_events"] == len(own)
            if pos == 0:
                assert row["loss"] is None and row["in_topk"] is None
            elif len(tokens) >= 6:
                assert row["loss"] == 0.0
            else:
                before = [t for earlier in own[:pos] for t in earlier]
                line = before + tokens
                losses = [-math.log((pairs[line[i - 1], line[i]] + 1) / (after[line[i - 1]] + vocab)) if i else None for i in range(len(before), len(line))]
                if None not in losses:
                    assert row["loss"] == pytest.approx(sum(losses) / len(losses))


def test_last_tokens_before_each_event(spark, events):
    out = token_model.token_context(sessions.with_position(events(LOG)), 4, chunk_rows=5)
    got = {(r["session_id"], r["pos"]): (r["event"], r["context"]) for r in out.collect()}
    texts = {}
    for s, _, event, _ in LOG:
        texts.setdefault(s, []).append(event)
    for session, own in plain_tokens(LOG).items():
        for pos in range(len(own)):
            assert got[session, pos] == (texts[session][pos], [t for e in own[:pos] for t in e][-4:])


def test_detection_takes_the_mean_loss(spark, events):
    """A session whose words do not occur elsewhere is flagged, one like the others is not."""
    rows = [(f"s{i}", t, f"job step{t % 3} done", 0) for i in range(60) for t in range(6)]
    rows += [("odd", t, f"job step{t % 3} done" if t < 4 else "disk broken badly", int(t == 5)) for t in range(6)]
    found = {r["session_id"]: r for r in detection.token_detections(events(rows), 2.5, 2, skip=2).collect()}
    assert found["odd"]["predicted"] == 1 and found["odd"]["alert_pos"] == 4
    assert {r["predicted"] for s, r in found.items() if s != "odd"} == {0}


def test_updated_model_equals_refit(spark, skewed):
    contexts = sessions.sessionize_with_previous(skewed, 2)
    days = contexts.selectExpr("*", "cast(substring(md5(concat(session_id, pos)), 1, 1) in ('0', '1', '2', '3') as int) day")
    first, second = days.filter("day = 0"), days.filter("day = 1")
    whole = {tuple(r) for r in fit_next_event(contexts, 2).collect()}
    grown = update_model(fit_next_event(first, 2), added=count_grams(second, 2))
    assert {tuple(r) for r in grown.collect()} == whole and grown.count() == len(whole)
    shrunk = update_model(grown, removed=count_grams(first, 2))
    assert {tuple(r) for r in shrunk.collect()} == {tuple(r) for r in fit_next_event(second, 2).collect()}
    moved = update_model(fit_next_event(first, 2), count_grams(second, 2), count_grams(first, 2))
    assert {tuple(r) for r in moved.collect()} == {tuple(r) for r in fit_next_event(second, 2).collect()}
    assert {tuple(r) for r in rank_grams(count_grams(first, 2)).collect()} == {tuple(r) for r in update_model(fit_next_event(first, 2)).collect()}
    with pytest.raises(Exception, match="more was taken away"):
        update_model(fit_next_event(first, 2), removed=count_grams(contexts, 2)).collect()
