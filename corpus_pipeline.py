"""Corpus pipeline: language, near-duplicates, decontamination, mixing, sharding.

Each stage takes the documents its predecessor kept, decides on all of them and returns
documents; the last one adds shard, slot and size.  Stages number the rows they get, so
repeated and null ids are harmless: a row stays or goes by itself.  Between stages the
documents are written to the shared folder, so a lost executor costs one stage at most.

A stage's result has been written and read again when the next stage is called, so that
one begins by removing the tables its predecessor left in the shared folder.

Rejected rows are few or many; they are sent to the executors only below a checked number
(see ``without``).  An empty table passes through all stages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseq.llm import decontamination, kd_sharding, language, mixing, simhash
from vigilseq.llm.common import numbered, read_table, without
from vigilseq.sources.staging import release, scope, stage

SHARDS = 24
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")  # of the documents that stages read
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def cleared(function: Stage) -> Stage:
    """Stage that removes what the stage before it left behind.

    Columns that stages do not know pass under names that cannot clash with their own; a
    column with the name of one that a stage adds gives way to it.
    """

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        aside = {c: f"extra_column_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        back = {hidden: c for c, hidden in aside.items()}
        with scope("pipeline"):
            out = function(spark, docs.select(*[docs[f"`{c}`"].alias(aside.get(c, c)) for c in docs.columns]), sf_dir)
        own = [c for c in out.columns if back.get(c) not in out.columns]
        return out.select(*[F.col(c).alias(back.get(c, c)) for c in own])

    return run


@cleared
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known; null, empty and letterless texts go."""
    rows = numbered(docs)
    languages, model = language.train(language.label_rows(rows))
    found = language.identify(language.document_evidence(rows, "_row"), languages, model)
    return without(rows, found.filter(~F.col("accepted"))).select(docs.columns)


@cleared
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document with the smallest id; groups are those of the SimHash operator."""
    rows = numbered(docs)
    groups = simhash.simhash_components(rows, "_row").select(F.col("id").alias("_row"), F.col("component_id").alias("group"))
    named = stage(groups.join(rows.select("_row", "doc_id"), "_row").select("_row", "group", "doc_id"), "groups")
    # Null ids come last, equal ids by row.
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    kept = stage(first.select(F.col("first._row").alias("_row")), "kept")
    return without(rows, named.join(kept, "_row", "left_anti")).select(docs.columns)


@cleared
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no passage of the benchmark."""
    rows = numbered(docs)
    leaks = decontamination.find_leaks(rows, read_table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(rows, leaks.select(F.col("id").alias("_row")).distinct()).select(docs.columns)


@cleared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their tempered shares, in shuffled order."""
    return mixing.replicate(docs).select(docs.columns)


@cleared
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every document into one of ``SHARDS`` shards of near-equal bytes."""
    return kd_sharding.kd_shards(docs, kd_sharding.text_size(), ["n_chars", "source", "lang", "doc_id"], SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The language model, fingerprints and latent retrieval have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
