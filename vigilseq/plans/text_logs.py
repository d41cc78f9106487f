"""Queries over logs of raw text: templates learned from lines, and scores of the tokens in a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilseq.operators import model, sessions, templates, token_model
from vigilseq.plans import detection, logs
from vigilseq.plans.registry import query

MINING = {"leading": 1, "max_values": 6, "share": 0.1, "variants": 3}
TOKENS = 10
TOKEN_THRESHOLD = 1.1


@query("p13_mine_templates")
def p13_mine(spark, folder):
    return templates.mine_templates(logs.plain_lines(spark, folder), **MINING)


@query("p13_mine_masked_templates")
def p13_masked(spark, folder):
    """The default limits, over lines whose numbers and addresses are masked first."""
    return templates.mine_templates(logs.raw_lines(spark, folder), rules=[r"blk_-?[0-9]+", r"/[0-9.:]+"])


@query("p14_match_templates")
def p14_match(spark, folder):
    """Templates of the lines of even users, and all lines matched to them."""
    lines = logs.plain_lines(spark, folder)
    known = templates.mine_templates(lines.filter("user_id % 2 = 0"), **MINING)
    return templates.match_templates(lines, known).select("tiebreak", "template", "event", "known")


@query("p14_extend_templates")
def p14_extend(spark, folder):
    """Templates of the lines that are no errors, extended by all the others."""
    lines = logs.plain_lines(spark, folder)
    error = F.startswith("line", F.lit("ERROR"))
    known = templates.mine_templates(lines.filter(~error), **MINING)
    return templates.extend_templates(known, lines.filter(error | (F.col("user_id") % 2 == 1)), **MINING)


@query("g13_token_context")
def g13_tokens(spark, folder):
    out = token_model.token_context(sessions.with_position(logs.text_log(spark, folder)), 12)
    return out.select("session_id", "pos", F.size("context").alias("n_context"), F.md5(F.array_join("context", " ")).alias("digest"))


@query("n4_token_loss")
def n4_tokens(spark, folder):
    """Mean loss over the tokens of an event, contexts of up to two tokens; longer events than the window have none."""
    contexts = detection.stored_contexts(logs.text_log(spark, folder), 2)
    scored = detection.token_scores(contexts, 2, k=5, skip=2, min_ctx=20, max_tokens=TOKENS)
    return scored.select("session_id", "pos", "n_tokens", "loss", "in_topk")


@query("n7_detect_tokens")
def n7_tokens(spark, folder):
    found = detection.token_detections(logs.text_log(spark, folder), TOKEN_THRESHOLD, 2)
    return found.select("session_id", "label", "predicted", "alert_pos", "alert_loss", "max_loss", "lead_min")


@query("n1_update_model")
def n1_update(spark, folder):
    """A model of the first half of the days, to which the other days are added and from which the first day is taken."""
    daily = detection.daily_grams(detection.labelled_contexts(logs.week_log(spark, folder), 2), 2)
    first, last = daily.agg(F.min("day"), F.max("day")).first()
    half = (first + last) // 2
    known = detection.model_of_days(daily.filter(F.col("day") <= half))
    return model.update_model(known, daily.filter(F.col("day") > half), daily.filter(F.col("day") == first))
