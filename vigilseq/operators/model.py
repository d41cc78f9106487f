"""Next-event model: conditional counts with backoff, Top-K sets and surprise.

The model table is ``ngrams(order, ctx, next, cnt, ctx_cnt, rank)``.  ``ctx`` is
the ``order`` events before ``next``, oldest first, joined by a control
character.  ``rank`` numbers the likeliest successors of a context by
(cnt desc, next asc); all of them are kept, so any K can be asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.functions.numeric import perplexity
from vigilseq.functions.text import null_event
from vigilseq.sources.staging import stage

JOINER = "\x01"
BROADCAST_BYTES = 64 << 20  # largest model that is broadcast to every executor


def context_text(order: int) -> Column:
    """Context key of ``order`` events from the prev columns; null when there are fewer."""
    if order == 0:
        return F.lit("")
    first, *rest = [F.col(f"prev{i}") for i in range(order, 0, -1)]
    return F.when(first.isNotNull(), F.concat_ws(JOINER, first, *[null_event(p) for p in rest]))


def count_grams(contexts: DataFrame, order: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(*by, order, ctx, next, cnt): successors of every context of up to ``order`` events.

    ``contexts`` are the training rows from ``with_previous``.  They are reduced
    to distinct patterns before anything is shuffled; all orders are then
    derived from the patterns, not from the rows.  Counts of several days, kept apart by
    ``by``, add up to those of all.
    """
    previous = [f"prev{i}" for i in range(1, order + 1)]
    patterns = contexts.groupBy(*by, *previous, "event").agg(F.count(F.lit(1)).alias("cnt"))
    per_order = F.array(
        *[F.struct(F.lit(k).alias("order"), context_text(k).alias("ctx")) for k in range(order + 1)]
    )
    return (
        patterns.select(*by, F.explode(per_order).alias("o"), F.col("event").alias("next"), "cnt")
        .select(*by, "o.order", "o.ctx", "next", "cnt")
        .filter("ctx is not null")
        .groupBy(*by, "order", "ctx", "next")
        .agg(F.sum("cnt").alias("cnt"))
    )


def rank_grams(counts: DataFrame) -> DataFrame:
    """Model table from the counts of all contexts."""
    likeliest = Window.partitionBy("order", "ctx").orderBy(F.desc("cnt"), "next")
    whole = likeliest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The window holds the successors of a context: at most the vocabulary.
    return counts.withColumns({"ctx_cnt": F.sum("cnt").over(whole), "rank": F.row_number().over(likeliest)})


def fit_next_event(contexts: DataFrame, order: int = 1) -> DataFrame:
    """Model of the training rows ``contexts``."""
    return rank_grams(count_grams(contexts, order))


def update_model(ngrams: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Model after more counts (order, ctx, next, cnt) came in and others were taken away.

    Only contexts that the changes touch are summed and ranked anew; the rows of all others
    pass through.  The result equals a fit on what is left.  Taking away more than was
    counted is an error.  Stage or save the result before it is read several times.
    """
    names = ["order", "ctx", "next", "cnt"]
    signs = [(df, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not signs:
        return ngrams
    parts = [df.select("order", "ctx", "next", (F.col("cnt") * sign).alias("cnt")) for df, sign in signs]
    change = reduce(DataFrame.unionByName, parts).groupBy("order", "ctx", "next").agg(F.sum("cnt").alias("cnt"))
    change = stage(change.filter("cnt != 0"), "change")
    touched = stage(change.select("order", "ctx").distinct(), "touched")
    sums = ngrams.join(touched, ["order", "ctx"], "left_semi").select(*names).unionByName(change)
    sums = sums.groupBy("order", "ctx", "next").agg(F.sum("cnt").alias("cnt"))
    checked = F.when(F.col("cnt") >= 0, F.col("cnt")).otherwise(F.raise_error(F.lit("more was taken away than was counted")))
    anew = rank_grams(sums.withColumn("cnt", checked).filter("cnt > 0"))
    return ngrams.join(touched, ["order", "ctx"], "left_anti").unionByName(anew.select(*ngrams.columns))


def topk_next(ngrams: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` likeliest next events of each context (limited before the shuffle by Catalyst)."""
    likeliest = Window.partitionBy("order", "ctx").orderBy(F.desc("cnt"), "next")
    return ngrams.withColumn("rank", F.row_number().over(likeliest)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class ModelSize:
    """Totals of a model table, one row read to the driver."""

    events: int  # rows the model was fitted on
    vocab: int  # distinct events, plus one for unknown
    data_bytes: int

    @staticmethod
    def of(ngrams: DataFrame) -> ModelSize:
        row = ngrams.agg(
            F.sum(F.when(F.col("order") == 0, F.col("cnt"))),
            F.count_if(F.col("order") == 0),
            F.sum(F.octet_length("ctx") + F.octet_length("next") + 40),
        ).first()
        return ModelSize(row[0] or 0, (row[1] or 0) + 1, row[2] or 0)


def look_up(
    rows: DataFrame, ngrams: DataFrame, size: ModelSize, order: int, k: int, alpha: float, min_ctx: int, small: bool
) -> DataFrame:
    """Add ``loss`` and ``in_topk`` from the highest order whose context is known well enough."""

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    out = rows
    cnt, ctx_cnt, in_topk = F.col("_c0"), F.lit(float(size.events)), F.col("_t0")
    for o in range(order + 1):
        pairs = ngrams.filter(F.col("order") == o).select(
            F.col("ctx").alias(f"_x{o}"),
            F.col("next").alias("event"),
            F.col("cnt").alias(f"_c{o}"),
            F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"_t{o}"),
        )
        if o == 0:
            out = out.join(side(pairs.drop("_x0")), "event", "left")
            continue
        contexts = (
            ngrams.filter((F.col("order") == o) & (F.col("ctx_cnt") >= min_ctx))
            .select(F.col("ctx").alias(f"_x{o}"), F.col("ctx_cnt").alias(f"_n{o}"))
            .distinct()
        )
        out = out.withColumn(f"_x{o}", context_text(o))
        out = out.join(side(contexts), f"_x{o}", "left").join(side(pairs), [f"_x{o}", "event"], "left")
        known = F.col(f"_n{o}").isNotNull()
        cnt = F.when(known, F.col(f"_c{o}")).otherwise(cnt)
        ctx_cnt = F.when(known, F.col(f"_n{o}")).otherwise(ctx_cnt)
        in_topk = F.when(known, F.col(f"_t{o}")).otherwise(in_topk)
    chance = (F.coalesce(cnt, F.lit(0)) + alpha) / (ctx_cnt + alpha * size.vocab)
    return out.select(
        *rows.columns, (-F.log(chance)).alias("loss"), F.coalesce(in_topk, F.lit(False)).alias("in_topk")
    )


def score_events(
    contexts: DataFrame,
    ngrams: DataFrame,
    order: int = 1,
    k: int = 5,
    skip: int = 1,
    alpha: float = 1.0,
    min_ctx: int = 1,
    broadcast_bytes: int = BROADCAST_BYTES,
    size: ModelSize | None = None,
) -> DataFrame:
    """Loss and Top-K membership of every event; null for the first ``skip`` of a session.

    Pass a staged or saved model: its size is read first unless given.  A small model is
    broadcast, so rows are scored where they are.  A large one is joined to the
    distinct patterns, and only the scored patterns are joined to the rows.
    """
    size = size or ModelSize.of(ngrams)
    small = size.data_bytes <= broadcast_bytes
    arguments = (ngrams, size, order, k, alpha, min_ctx, small)
    if small:
        scored = look_up(contexts, *arguments)
    else:
        pattern = [*[f"prev{i}" for i in range(1, order + 1)], "event"]
        patterns = look_up(contexts.select(*pattern).distinct(), *arguments)
        patterns = patterns.select(*[F.col(c).alias(f"_p_{c}") for c in pattern], "loss", "in_topk")
        match = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in pattern]
        scored = contexts.join(patterns, match, "left").drop(*[f"_p_{c}" for c in pattern])
    scorable = F.col("pos") >= max(1, skip)
    return scored.withColumns(
        {"loss": F.when(scorable, F.col("loss")), "in_topk": F.when(scorable, F.col("in_topk"))}
    )


def session_loss(scored: DataFrame) -> DataFrame:
    """Mean and highest loss per session; null where no event was scored."""
    return scored.groupBy("session_id").agg(
        F.max("session_label").alias("label"),
        F.avg("loss").alias("avg_loss"),
        F.max("loss").alias("max_loss"),
        F.count("loss").alias("n_scored"),
    )


def model_perplexity(scored: DataFrame) -> DataFrame:
    """Mean loss and perplexity over the scored rows (pass the validation rows)."""
    mean = scored.agg(F.avg("loss").alias("mean_loss"), F.count("loss").alias("n_scored"))
    return mean.withColumn("perplexity", perplexity(F.col("mean_loss")))
