"""Scores of the tokens inside an event: loss per token, averaged per event.

Events are texts.  Their words are the tokens, and every event but the first of a session
begins with ``SEPARATOR``.  A token's context is the ``order`` tokens before it, across
event borders.  As every later event has a token, they lie in the ``order`` events before,
which the context rows carry already: nothing is shuffled to find them.  Token rows have
the columns of event rows, so model and scoring are those of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.functions.text import null_event
from vigilseq.operators.ordered import CHUNK_ROWS
from vigilseq.operators.sessions import with_context

SEPARATOR = "\n"
MAX_TOKENS = 1024  # tokens the reference's scorer sees at once (fixed value)


def event_tokens(event: Column, pos: Column) -> Column:
    """Words of an event, after a separator where it is not the first."""
    words = F.filter(F.split(null_event(event), "[ \t]+"), lambda t: t != "")
    return F.when(pos > 0, F.concat(F.array(F.lit(SEPARATOR)), words)).otherwise(words)


def _last(tokens: Column, n: int) -> Column:
    return F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, F.lit(n))


def token_rows(contexts: DataFrame, order: int) -> DataFrame:
    """Rows (.., pos, sub, n_tokens, text, event, prev1 ..): one per token, ``event`` and ``prev`` being tokens.

    ``contexts`` has the events before as ``prev1`` .. ``prev<order>`` (see
    ``sessionize_with_previous``).  An event without tokens has one row without a token.
    """
    previous = [f"prev{i}" for i in range(1, order + 1)]
    kept = [c for c in contexts.columns if c not in ("event", *previous)]
    pos = F.col("pos")
    earlier = [F.when(pos >= i, event_tokens(F.col(f"prev{i}"), pos - i)).otherwise(F.array().cast("array<string>")) for i in range(order, 0, -1)]
    before = _last(F.concat(*earlier), order) if earlier else F.array().cast("array<string>")
    rows = contexts.select(*kept, F.col("event").alias("text"), before.alias("_before"), event_tokens(F.col("event"), pos).alias("_own"))
    rows = rows.select(*kept, "text", "_before", "_own", F.posexplode_outer("_own").alias("sub", "event"))

    def back(i: int) -> Column:
        return F.when(F.col("sub") >= i, F.get("_own", F.col("sub") - i)).otherwise(F.get("_before", F.size("_before") + F.col("sub") - i))

    return rows.select(*kept, "text", F.size("_own").alias("n_tokens"), "sub", "event", *[back(i).alias(f"prev{i}") for i in range(1, order + 1)])


def event_loss(scored: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Event rows with ``loss``, the mean over their tokens, and ``in_topk``, whether all tokens are.

    ``scored`` are token rows from ``model.score_events``.  An event that fills the scorer's
    window of ``max_tokens`` by itself has no context left and loss zero.
    """
    inside = ("sub", "event", "loss", "in_topk", "text", "session_id", "pos")
    kept = [c for c in scored.columns if c not in inside and not c.startswith("prev")]
    mean = F.when(F.count("loss") > 0, F.when(F.first("n_tokens") >= max_tokens, 0.0).otherwise(F.avg("loss")))
    return scored.groupBy("session_id", "pos").agg(
        *[F.first(c).alias(c) for c in kept], F.first("text").alias("event"), mean.alias("loss"), F.bool_and("in_topk").alias("in_topk")
    )


def token_context(positioned: DataFrame, n: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``context``: the last ``n`` tokens before each event."""
    rows = positioned.withColumn("_text", F.col("event")).withColumn("event", event_tokens(F.col("event"), F.col("pos")))
    out = with_context(rows, n, chunk_rows)
    return out.withColumn("context", _last(F.flatten("context"), n)).withColumn("event", F.col("_text")).drop("_text")
