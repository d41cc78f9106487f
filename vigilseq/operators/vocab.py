"""Event vocabulary: numbering, encoding, overlap, frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseq.operators.ordered import running_totals
from vigilseq.operators.rows import normal_rows
from vigilseq.sources.staging import stage

# Fixed special tokens of the reference.
PAD, UNK, SEP = "<PAD>", "<UNK>", "<SEP>"
PAD_ID, UNK_ID, SEP_ID, FIRST_ID = 0, 1, 2, 3
BROADCAST_EVENTS = 500_000  # events of a vocabulary that are sent to every executor


def fit_vocab(events: DataFrame) -> DataFrame:
    """Ids of the distinct events of normal rows, sorted by code point, from 3 on."""
    distinct = normal_rows(events).select("event").distinct()
    numbered = running_totals(distinct, [], ["event"], {"at": F.lit(1)}, summary=True)
    return numbered.select("event", (F.col("at") + FIRST_ID).cast("int").alias("token_id"))


def with_special(vocab: DataFrame) -> DataFrame:
    """Vocabulary with the three special tokens, as it is saved."""
    special = vocab.sparkSession.createDataFrame(
        [(PAD, PAD_ID), (UNK, UNK_ID), (SEP, SEP_ID)], "event string, token_id int"
    )
    return special.unionByName(vocab)


def encode(positioned: DataFrame, vocab: DataFrame, add_sep: bool = False) -> DataFrame:
    """Token rows (session_id, pos, token_id); unknown or null events become UNK.

    With ``add_sep`` a separator stands between the events of a session, which
    needs ``n_events`` (see ``sessionize``); positions then count tokens.
    """
    known = vocab.select("event", "token_id")
    small = known.count() <= BROADCAST_EVENTS
    out = positioned.join(F.broadcast(known) if small else known, "event", "left").withColumn(
        "token_id", F.coalesce("token_id", F.lit(UNK_ID))
    )
    if not add_sep:
        return out.select("session_id", "pos", "token_id")
    event = F.struct((F.col("pos") * 2).alias("pos"), F.col("token_id"))
    sep = F.struct((F.col("pos") * 2 + 1).alias("pos"), F.lit(SEP_ID).alias("token_id"))
    last = F.col("pos") == F.col("n_events") - 1
    pieces = F.explode(F.when(last, F.array(event)).otherwise(F.array(event, sep)))
    return out.select("session_id", pieces.alias("t")).select("session_id", "t.pos", "t.token_id")


def decode(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Event text of each token id; unknown ids become ``<UNK>``."""
    known = with_special(vocab)
    small = known.count() <= BROADCAST_EVENTS
    return tokens.join(F.broadcast(known) if small else known, "token_id", "left").withColumn("event", F.coalesce("event", F.lit(UNK)))


def event_dictionary(events: DataFrame) -> DataFrame:
    """Template text of each event id, from events that carry both."""
    return events.filter(F.col("event").isNotNull()).groupBy("event").agg(F.min("template").alias("template"))


def with_template(detections: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Add the template of the event id in ``column``, null where it has none."""
    named = stage(dictionary.select(F.col("event").alias(column), F.col("template").alias(f"{column}_template")), "dictionary")
    return detections.join(F.broadcast(named) if named.count() <= BROADCAST_EVENTS else named, column, "left")


def event_labels(events: DataFrame) -> DataFrame:
    """Per event: rows, and whether normal and anomalous rows carry it."""
    return (
        events.filter(F.col("event").isNotNull())
        .groupBy("event")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.max(F.when(F.col("label") == 0, 1).otherwise(0)).alias("in_normal"),
            F.max(F.when(F.col("label") == 1, 1).otherwise(0)).alias("in_anomalous"),
        )
    )


def vocab_overlap(events: DataFrame) -> DataFrame:
    """Counts of events seen only in normal rows, only in anomalous rows, in both."""
    normal, anomalous = F.col("in_normal") == 1, F.col("in_anomalous") == 1
    return event_labels(events).agg(
        F.count_if(normal & ~anomalous).alias("normal_only"),
        F.count_if(~normal & anomalous).alias("anomaly_only"),
        F.count_if(normal & anomalous).alias("shared"),
    )


def event_frequency(events: DataFrame, max_count: int | None = None) -> DataFrame:
    """Rows per event; with ``max_count`` only the rare ones."""
    out = events.filter(F.col("event").isNotNull()).groupBy("event").agg(F.count(F.lit(1)).alias("cnt"))
    return out if max_count is None else out.filter(F.col("cnt") <= max_count)


def event_diversity(events: DataFrame) -> DataFrame:
    """Number of distinct events of a dataset."""
    return events.select("event").distinct().agg(F.count("event").alias("n_events"))
