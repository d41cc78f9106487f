"""The two detectors end to end: log in, one detection per test session out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseq.functions.text import null_event
from vigilseq.operators.detect import detect_threshold, detect_topk
from vigilseq.operators.evaluate import ksigma_threshold
from vigilseq.operators.leadtime import lead_to_end, lead_to_first_error, steps_before_error
from vigilseq.operators.model import count_grams, fit_next_event, rank_grams, score_events, session_loss
from vigilseq.operators.sessions import sessionize_with_previous
from vigilseq.operators.splits import hash_pct, split_name, test_after_calibration
from vigilseq.operators.token_model import MAX_TOKENS, event_loss, token_rows
from vigilseq.sources.staging import stage

MICROS_PER_DAY = 86400 * 1_000_000
CUTS = (80, 90)  # percent of the normal sessions up to which they train and validate


def labelled_contexts(events: DataFrame, order: int = 1) -> DataFrame:
    """Events with position, session label, split and the events before them.

    Label and split are columns of the row, so no later step joins rows to a session
    table.  A session with a row without time has no order and is left out.
    """
    named = events.withColumn("event", null_event(F.col("event")))
    rows = sessionize_with_previous(named, order, timed=True)
    return rows.withColumn("split", split_name(F.col("session_id"), F.col("session_label"), CUTS))


def stored_contexts(events: DataFrame, order: int = 1) -> DataFrame:
    """The labelled contexts as a staged table, one folder per split.

    Model and scoring both need them: the log is shuffled once, and each of the
    two reads only the files of its split.
    """
    return stage(labelled_contexts(events, order), "contexts", "split")


def fit(contexts: DataFrame, order: int = 1, normal_scope: str = "session") -> DataFrame:
    """Model of the training rows, staged.

    ``normal_scope='session'`` trains on normal sessions of the train split;
    ``'row'`` on every row labelled normal, whatever its session.
    """
    rows = contexts.filter("label = 0") if normal_scope == "row" else train_rows(contexts)
    return stage(fit_next_event(rows, order), "ngrams")


def daily_grams(contexts: DataFrame, order: int = 1) -> DataFrame:
    """Counts of the training rows per day, stored one folder per day; ``day`` is the number of days since 1970."""
    rows = train_rows(contexts).withColumn("day", F.expr(f"unix_micros(ts) div {MICROS_PER_DAY}"))
    return stage(count_grams(rows, order, ["day"]), "grams", "day")


def model_of_days(daily: DataFrame) -> DataFrame:
    """Staged model of the days in ``daily``."""
    return stage(rank_grams(daily.groupBy("order", "ctx", "next").agg(F.sum("cnt").alias("cnt"))), "ngrams")


def train_rows(contexts: DataFrame) -> DataFrame:
    """Rows of the train split; the hash alone is tested too, because it can be pushed below the windows."""
    return contexts.filter(hash_pct(F.col("session_id")) < CUTS[0]).filter("split = 'train'")


def topk_detections(events: DataFrame, order: int = 1, k: int = 5) -> DataFrame:
    """Test sessions flagged when an event is not among the K likeliest, with lead to the first error."""
    contexts = stored_contexts(events, order)
    scored = score_events(contexts.filter("split = 'test'"), fit(contexts, order), order, k)
    return steps_before_error(lead_to_first_error(detect_topk(scored)))


def ksigma_detections(events: DataFrame, k: float, order: int = 1, skip: int = 3) -> DataFrame:
    """Threshold detections with the threshold taken from the highest losses of the validation sessions."""
    contexts = stored_contexts(events, order)
    ngrams = fit(contexts, order)
    healthy = score_events(contexts.filter("split = 'val'"), ngrams, order, skip=skip)
    threshold = ksigma_threshold(session_loss(healthy), k).first()["threshold"]  # one row
    if threshold is None:
        raise ValueError("no validation session has a scored event, so there is no threshold")
    scored = score_events(contexts.filter("split = 'test'"), ngrams, order, skip=skip)
    return steps_before_error(lead_to_end(detect_threshold(scored, threshold, skip)))


def stored_threshold_detections(contexts: DataFrame, ngrams: DataFrame, threshold: DataFrame, skip: int = 3) -> DataFrame:
    """Detections of the test sessions that were not calibrated on, with a stored threshold (one row)."""
    value = threshold.first()["threshold"]
    rows = test_after_calibration(contexts.withColumn("_row_label", F.col("label")).withColumn("label", F.col("session_label")))
    rows = rows.withColumn("label", F.col("_row_label")).drop("_row_label")
    return steps_before_error(lead_to_end(detect_threshold(score_events(rows, ngrams, skip=skip), value, skip)))


def threshold_detections(events: DataFrame, threshold: float, order: int = 1, skip: int = 3) -> DataFrame:
    """Test sessions flagged when an event surprises more than the threshold, with lead to the end."""
    contexts = stored_contexts(events, order)
    scored = score_events(contexts.filter("split = 'test'"), fit(contexts, order), order, skip=skip)
    return steps_before_error(lead_to_end(detect_threshold(scored, threshold, skip)))


def token_scores(contexts: DataFrame, order: int = 2, k: int = 5, skip: int = 3, min_ctx: int = 1, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Scored events whose loss is the mean over the tokens of their text, from stored contexts of the same order."""
    tokens = token_rows(contexts, order)
    known = tokens.filter("event is not null")
    scored = score_events(tokens, fit(known, order), order, k, skip, min_ctx=min_ctx)
    return event_loss(scored, max_tokens)


def token_detections(events: DataFrame, threshold: float, order: int = 2, skip: int = 3, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Test sessions flagged when the mean loss over the tokens of an event is above the threshold, with lead to the end."""
    contexts = stored_contexts(events, order)
    tokens = token_rows(contexts, order)
    ngrams = fit(tokens.filter("event is not null"), order)
    scored = event_loss(score_events(tokens.filter("split = 'test'"), ngrams, order, skip=skip), max_tokens)
    return steps_before_error(lead_to_end(detect_threshold(scored, threshold, skip)))
