"""Summaries that are stored per day and merged: quantiles, distinct counts, frequent events.

Quantiles are KLL sketches: a quantile's rank is off by at most ``rank_error(k)`` in 99 of
100 cases, however many sketches were merged.  Distinct counts are theta sketches, exact up
to ``2 ** lg_entries`` values and off by about ``1 / sqrt(2 ** lg_entries)`` above, also for
unions, intersections and differences.  Frequent events are the counts of the ``m`` most
frequent events of a part, with the highest count that was left out; merged, they bound
every event's count from both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KLL_K = 200
LG_ENTRIES = 12
FREQUENT = 1024


def rank_error(k: int = KLL_K) -> float:
    """Error of a rank as a share of all values, at 99 % confidence (published fit for this sketch, fixed values)."""
    return 2.296 / k**0.9723


def quantile_sketches(df: DataFrame, column: str, by: Sequence[str], k: int = KLL_K) -> DataFrame:
    """(*by, sketch) of the values of a column; nulls do not count."""
    values = df.filter(F.col(column).isNotNull()).withColumn("_value", F.col(column).cast("double"))
    return values.groupBy(*by).agg(F.kll_sketch_agg_double("_value", F.lit(k)).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, qs: dict[str, float]) -> DataFrame:
    """The sketches' other columns with ``n`` values and one column per name in ``qs``."""
    others = [c for c in sketches.columns if c != "sketch"]
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in qs.items()]
    return sketches.select(*others, F.kll_sketch_get_n_double("sketch").alias("n"), *found)


def distinct_sketches(df: DataFrame, column: str, by: Sequence[str], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(*by, sketch) of the distinct values of a column; nulls do not count."""
    values = df.filter(F.col(column).isNotNull())
    return values.groupBy(*by).agg(F.theta_sketch_agg(column, F.lit(lg_entries)).alias("sketch"))


def merge_distinct_sketches(sketches: DataFrame, by: Sequence[str], lg_entries: int = LG_ENTRIES) -> DataFrame:
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", F.lit(lg_entries)).alias("sketch"))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """The sketches' other columns with ``n_distinct``."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], _estimate(F.col("sketch")).alias("n_distinct"))


def sketch_overlap(sketches: DataFrame, first: Column, second: Column) -> DataFrame:
    """One row: distinct values of the sketches that ``first`` selects alone, of ``second`` alone, and of both.

    A side without sketches has no values.
    """
    union = lambda side: F.theta_union_agg(F.when(side, F.col("sketch")))
    sides = sketches.agg(union(first).alias("a"), union(second).alias("b"), F.count_if(first).alias("n_a"), F.count_if(second).alias("n_b"))
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    only = lambda one, other, n: F.when(both, _estimate(F.theta_difference(one, other))).when(F.col(n) > 0, _estimate(F.col(one))).otherwise(0)
    shared = F.when(both, _estimate(F.theta_intersection("a", "b"))).otherwise(0)
    return sides.select(only("a", "b", "n_a").alias("first_only"), only("b", "a", "n_b").alias("second_only"), shared.alias("shared"))


def frequent_summary(events: DataFrame, by: Sequence[str], m: int = FREQUENT, column: str = "event") -> DataFrame:
    """(*by, event, cnt, floor): the ``m`` most frequent events of each part and the highest count left out.

    The limit is applied before the shuffle to the parts.
    """
    counts = events.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("event")).agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(*by).orderBy(F.desc("cnt"), "event")
    top = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= m + 1)
    left_out = F.max(F.when(F.col("_rank") == m + 1, F.col("cnt"))).over(Window.partitionBy(*by))
    return top.withColumn("floor", F.coalesce(left_out, F.lit(0))).filter(F.col("_rank") <= m).drop("_rank")


def merge_summaries(summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """(event, lower, upper, floor) over all parts, ``by`` telling the parts apart.

    An event's count lies between ``lower`` and ``upper``; one that is missing has at most
    ``floor``, so no event above it is missed.
    """
    total = summaries.select(*by, "floor").distinct().agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("floor"))
    sums = summaries.groupBy("event").agg(F.sum("cnt").alias("lower"), F.sum("floor").alias("_own"))
    joined = sums.join(F.broadcast(total))  # one row
    return joined.select("event", "lower", (F.col("lower") + F.col("floor") - F.col("_own")).alias("upper"), "floor")
