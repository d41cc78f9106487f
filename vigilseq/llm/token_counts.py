"""Token counts from an exact histogram of encoded lengths.

Documents are encoded with a public byte-level vocabulary and counted by length.  With
sums over the longer lengths, the histogram answers every context limit: documents and
tokens in all, above a limit, and after each document is cut at the limit.

The vocabulary file is read on the driver and sent with the tasks; its size is checked.
A length is one row, so the shuffle holds lengths, not documents.  Running sums are taken inside blocks of lengths and over
the blocks, of which there are as many as the longest document has thousands of tokens.

Null and empty texts have length zero.  An empty table gives no rows.  Every row counts,
repeated ones too.  Columns other than the text are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.llm.words import text_parts
from vigilseq.sources.staging import stage

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20  # largest file sent to the tasks
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"  # how the vocabulary splits text (fixed value)
BLOCK = 1024  # lengths summed in one block


def load_vocabulary(folder: str = FOLDER, name: str = VOCABULARY) -> bytes:
    """File of a byte-pair vocabulary as tokens and ranks."""
    with open(os.path.join(folder, name), "rb") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{name} is larger than {VOCABULARY_BYTES} bytes")
    return data


def encoder(data: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, vocabulary: bytes, text_col: str = "text") -> DataFrame:
    """(length) per document: its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or encoder(vocabulary).encode_ordinary
            parts = (texts for _, _, texts in text_parts(batch.column(0)))
            found = [len(encode(t.decode("utf-8", "replace"))) if t else 0 for texts in parts for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["length"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "length bigint")


def histogram(found: DataFrame) -> DataFrame:
    """Per length: documents, and the sums over shorter and longer lengths.

    ``docs_up_to`` and ``tokens_up_to`` include the row's own length; ``docs_above`` and
    ``tokens_above`` are the rest.  ``truncated_tokens`` is what is left when every
    document is cut at this length, ``quantile`` the share of documents up to it.
    """
    counts = found.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    counts = stage(counts, "lengths")  # read twice below; documents are encoded once
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = counts.withColumns({"docs_in": F.sum("n_docs").over(inside), "tokens_in": F.sum("tokens").over(inside)})
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("n").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    joined = own.join(blocks, F.col("block") == F.col("_block"))
    docs, tokens = F.col("docs_before") + F.col("docs_in"), F.col("tokens_before") + F.col("tokens_in")
    return joined.select(
        "length",
        "n_docs",
        docs.alias("docs_up_to"),
        tokens.alias("tokens_up_to"),
        (F.col("all_docs") - docs).alias("docs_above"),
        (F.col("all_tokens") - tokens).alias("tokens_above"),
        (tokens + F.col("length") * (F.col("all_docs") - docs)).alias("truncated_tokens"),
        (docs / F.col("all_docs")).alias("quantile"),
    )


def at_limits(found: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_above, tokens, truncated_tokens) for any limits, from a ``histogram``."""
    rows = found.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "context bigint")
    each = found.select("length", "n_docs").withColumn("_c", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sorted(set(limits))])))
    sums = each.groupBy("_c").agg(
        F.sum(F.when(F.col("length") > F.col("_c"), F.col("n_docs"))).alias("docs_above"),
        F.sum(F.col("length") * F.col("n_docs")).alias("tokens"),
        F.sum(F.least("length", "_c") * F.col("n_docs")).alias("truncated_tokens"),
    )
    return rows.join(sums, F.col("context") == F.col("_c"), "left").drop("_c").na.fill(0)


def length_at(found: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, length): the least length that this share of the documents does not exceed."""
    parts = [found.filter(F.col("quantile") >= q).agg(F.lit(float(q)).alias("quantile"), F.min("length").alias("length")) for q in quantiles]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def token_histogram(docs: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    return histogram(lengths(docs, load_vocabulary(folder, name)))
