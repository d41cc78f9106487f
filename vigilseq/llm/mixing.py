"""Mixing of sources to target weights by Poisson replication.

The repetition rate of a source is its target share of the output over its share of the
input, both in bytes.  Each document draws its number of copies from a Poisson law with
that mean: a uniform number made from a hash of (seed, id, text) is inverted through the
cumulative probabilities, so the draw does not depend on partitions or retries.  Copies
are numbered and shuffled globally: a hash of (seed, id, text, copy) places a copy in a
partition and inside it.

Rates are one row per source.  They are broadcast when there are at most
``BROADCAST_SOURCES``; otherwise documents and rates meet in a salted join, so that a source
with a third of all rows spreads over ``SALTS`` tasks.

Null sources are a source of their own.  Null texts have no bytes.  A source without
target weight, or without bytes, is kept at its own share.  Rows that agree in id and
text draw the same number.  Columns of the input keep their names; ``copy_no`` and
``rate`` are added by ``replicate`` and replace columns of that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.llm.common import unused
from vigilseq.sources.staging import stage

TEMPERING = 0.7  # default target: shares to this power
BROADCAST_SOURCES = 100_000
SALTS = 64
MOST_PER_DRAW = 8.0  # larger means are split in draws of this mean


def poisson(rate: Column, key: list[Column], most: float = MOST_PER_DRAW) -> Column:
    """Number drawn from a Poisson law of mean ``rate`` by inverting hash-made uniforms.

    A large mean is the sum of independent draws of means up to ``most``, each inverted
    until its tail is below the resolution of the uniform.
    """
    terms = math.ceil(most + 12 * math.sqrt(most) + 20)
    parts = F.greatest(F.lit(1), F.ceil(rate / most).cast("int"))
    mean = rate / parts

    def draw(part: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(part, *key), 11).cast("double") + 0.5) / float(1 << 53)
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).cast("bigint").alias("n"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            beyond = s["sum"] < uniform
            return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), (s["n"] + beyond.cast("bigint")).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["n"])

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("bigint"), lambda a, part: a + draw(part))


def size_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")


def source_rates(docs: DataFrame, weights: DataFrame | None, source_col: str, text_col: str, tempering: float = TEMPERING) -> DataFrame:
    """(source, size, rate) per source; ``weights(source, weight)`` need not add up to one."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_of(text_col)).cast("double").alias("size"))
    if weights is None:
        wanted = sizes.withColumn("weight", F.pow("size", F.lit(tempering)))
    else:
        own = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("weight"))
        wanted = sizes.join(own, sizes["source"].eqNullSafe(own["_s"]), "left").drop("_s")
    wanted = stage(wanted, "sources")
    total = wanted.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("weight") > 0, F.col("size"))).alias("weighted"), F.sum("weight").alias("weights"))
    rate = F.col("weight") / F.col("weights") * F.col("weighted") / F.col("size")
    kept = (F.col("weight") >= 0) & (F.col("size") > 0) & (F.col("weights") > 0)
    joined = wanted.join(F.broadcast(total))  # one row
    return joined.select("source", "size", F.when(kept, rate).otherwise(1.0).alias("rate"))


def replicate(
    docs: DataFrame,
    weights: DataFrame | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Every document as often as it was drawn, with ``copy_no`` from 0 and the ``rate`` of its source."""
    names = [c for c in docs.columns if c not in ("copy_no", "rate")]
    of_rate, salt, of, hashed, times, place = (unused(c, names) for c in ("_source", "_salt", "_of", "_text", "_times", "_place"))
    rates = stage(source_rates(docs, weights, source_col, text_col).select(F.col("source").alias(of_rate), "rate"), "rates")
    rows = docs.select(*[docs[f"`{c}`"] for c in names])
    same = rows[source_col].eqNullSafe(rates[of_rate])
    if rates.count() <= broadcast_sources:
        rated = rows.join(F.broadcast(rates), same)
    else:
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SALTS)).cast("int"))
        spread = rates.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rows.join(spread, rows[source_col].eqNullSafe(spread[of_rate]) & (rows[salt] == spread[of]))
    drawn = rated.withColumn(hashed, F.xxhash64(text_col))
    copies = drawn.withColumn(times, poisson(F.col("rate"), [F.lit(seed), F.col(id_col), F.col(hashed)]).cast("int"))
    copies = copies.filter(F.col(times) > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    shuffled = copies.withColumn(place, F.xxhash64(F.lit(seed + 1), id_col, hashed, "copy_no"))
    return shuffled.repartition(place).sortWithinPartitions(place).select(*[F.col(f"`{c}`") for c in names], "copy_no", "rate")
