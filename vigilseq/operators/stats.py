"""Rank, distribution and resampling statistics on scored sessions.

Curves and rank tests work on one row per distinct score, with running class
counts from ``running_totals``; tied scores are therefore one curve point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilseq.operators.evaluate import class_metrics, confusion, f1_of, ratio
from vigilseq.operators.ordered import running_totals

COUNTS = "tp long, fp long, tn long, fn long"


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return pd.Series([_t_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def ks_upper(lam: pd.Series) -> pd.Series:
    """Asymptotic Kolmogorov tail at lambda."""

    def tail(x: float) -> float:
        if x < 0.2:
            return 1.0
        terms = [(-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)]
        return min(1.0, max(0.0, 2 * sum(terms)))

    return lam.map(tail)


def _t_two_sided(t: float, df: float) -> float:
    """Integral of the t density by Simpson's rule in the angle atan(t / sqrt(df))."""
    angle = math.atan(abs(t) / math.sqrt(df))
    x = np.linspace(angle, math.pi / 2, 20001)
    y = np.cos(x) ** (df - 1)
    weights = np.ones_like(x)
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    area = float((y * weights).sum()) * (x[1] - x[0]) / 3
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return min(1.0, 2 * area * math.exp(log_norm))


def prefix_counts(
    df: DataFrame, score: str, label: str, descending: bool = False
) -> DataFrame:
    """One row per distinct score: n1, n0, counts before it (b1, b0) and totals (t1, t0)."""
    counts = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )
    order = F.desc("score") if descending else F.asc("score")
    return running_totals(
        counts,
        [],
        [order],
        {"b1": F.col("n1"), "b0": F.col("n0")},
        {"t1": F.sum("n1"), "t0": F.sum("n0")},
        summary=True,
    )


def rank_test(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney U of label 1 over label 0 (one-sided greater), AUROC, z and p."""
    placed = prefix_counts(df, score, label)
    ties = (F.col("n1") + F.col("n0")).cast("double")
    out = placed.agg(
        F.sum(F.col("n1") * (F.col("b0") + F.col("n0") / 2)).alias("u"),
        F.sum(F.pow(ties, 3.0) - ties).alias("tie_term"),
        F.max("t1").alias("n1"),
        F.max("t0").alias("n0"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sigma = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = F.when(sigma > 0, (F.col("u") - n1 * n0 / 2 - 0.5) / sigma)
    out = out.withColumns({"auroc": ratio(F.col("u"), n1 * n0), "z": z})
    return out.withColumn("p_value", normal_upper(F.coalesce("z", F.lit(0.0))))


def _class_moments(df: DataFrame, score: str, label: str) -> DataFrame:
    one, zero = F.when(F.col(label) == 1, F.col(score)), F.when(F.col(label) == 0, F.col(score))
    return df.agg(
        *[f(c).alias(f"{n}{k}") for k, c in ((1, one), (0, zero)) for n, f in (
            ("mean", F.avg), ("var", F.var_samp), ("std", F.stddev_pop), ("n", F.count))]
    )


def welch(df: DataFrame, score: str, label: str) -> DataFrame:
    """Welch's t of label 1 against label 0, degrees of freedom and p."""
    a, b = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    freedom = (a + b) ** 2 / (a**2 / (F.col("n1") - 1) + b**2 / (F.col("n0") - 1))
    out = _class_moments(df, score, label).select(
        ((F.col("mean1") - F.col("mean0")) / F.sqrt(a + b)).alias("t"), freedom.alias("df")
    )
    return out.withColumn("p_value", t_two_sided("t", "df"))


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p."""
    placed = prefix_counts(df, score, label)
    cdf1 = (F.col("b1") + F.col("n1")) / F.col("t1")
    cdf0 = (F.col("b0") + F.col("n0")) / F.col("t0")
    out = placed.agg(
        F.max(F.abs(cdf1 - cdf0)).alias("ks"), F.max("t1").alias("n1"), F.max("t0").alias("n0")
    )
    size = F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")))
    return out.withColumn("p_value", ks_upper(F.col("ks") * size))


def cohens_d(df: DataFrame, score: str, label: str) -> DataFrame:
    """Standardised distance of the class means, with its size word."""
    pooled = F.sqrt((F.col("std1") ** 2 + F.col("std0") ** 2) / 2)
    out = _class_moments(df, score, label).select(
        "mean1", "std1", "mean0", "std0", ratio(F.col("mean1") - F.col("mean0"), pooled).alias("d")
    )
    size = F.abs("d")
    word = F.when(size >= 0.8, "LARGE").when(size >= 0.5, "MEDIUM").when(size >= 0.2, "SMALL").otherwise("NEGLIGIBLE")
    return out.withColumn("effect", word)


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Precision and recall after each distinct score, from the highest down."""
    placed = prefix_counts(df, score, label, descending=True)
    tp, fp = F.col("b1") + F.col("n1"), F.col("b0") + F.col("n0")
    return placed.select(
        "score", tp.alias("tp"), fp.alias("fp"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("t1")).alias("recall")
    )


def auprc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the PR curve by trapezoids between its points; no first point is added.

    The point before is known from the row's own running counts.
    """
    placed = prefix_counts(df, score, label, descending=True)
    tp, fp = F.col("b1") + F.col("n1"), F.col("b0") + F.col("n0")
    before = ratio(F.col("b1"), F.col("b1") + F.col("b0"))
    area = F.col("n1") / F.col("t1") * (before + ratio(tp, tp + fp)) / 2
    first = (F.col("b1") + F.col("b0")) == 0
    return placed.agg(F.sum(F.when(first, 0.0).otherwise(area)).alias("auprc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum of precision times recall step."""
    placed = prefix_counts(df, score, label, descending=True)
    tp, fp = F.col("b1") + F.col("n1"), F.col("b0") + F.col("n0")
    return placed.agg(F.sum(F.col("n1") / F.col("t1") * ratio(tp, tp + fp)).alias("average_precision"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """False and true positive rate after each distinct score, from the highest down."""
    placed = prefix_counts(df, score, label, descending=True)
    tp, fp = F.col("b1") + F.col("n1"), F.col("b0") + F.col("n0")
    return placed.select("score", ratio(fp, F.col("t0")).alias("fpr"), ratio(tp, F.col("t1")).alias("tpr"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    placed = prefix_counts(df, score, label, descending=True)
    step = F.col("n0") / F.col("t0")
    height = (2 * F.col("b1") + F.col("n1")) / F.col("t1") / 2
    return placed.agg(F.sum(step * height).alias("roc_auc"))


# -- resampling ---------------------------------------------------------------


SPREAD = 12  # standard deviations of a law that are tabulated; beyond them a double holds nothing


def _uniform(trial: Column, part: str, seed: int) -> Column:
    """Number in (0, 1) that depends only on seed, part and trial."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(part), trial.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def _drawn(spark: SparkSession, trials: int, seed: int, part: str, least: int, most: int, mean: float, std: float, ratio: Column) -> DataFrame:
    """(trial, part): one number per trial by inverting the law with ``ratio`` = P(k + 1) / P(k) over column ``k``.

    The law is tabulated ``SPREAD`` deviations around its mean, so the table grows with the
    root of the counts.  Uniforms and cumulative chances are merged in one order.
    """
    low = max(least, math.floor(mean - SPREAD * std - SPREAD)) if std > 0 else round(mean)
    high = min(most, math.ceil(mean + SPREAD * std + SPREAD)) if std > 0 else round(mean)
    along = Window.orderBy("k")
    steps = spark.range(low, high + 1).withColumnRenamed("id", "k").withColumn("_step", F.when(F.col("k") < high, F.log(ratio)).otherwise(0.0))
    weights = steps.withColumn("_log", F.coalesce(F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    top = F.max("_log").over(Window.partitionBy())
    weights = weights.withColumn("_w", F.exp(F.col("_log") - top))
    chance = F.sum("_w").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("_w").over(Window.partitionBy())
    law = weights.select(chance.alias("_at"), F.lit(1).alias("_law"), F.lit(None).cast("bigint").alias("trial"))
    wanted = spark.range(trials).select(_uniform(F.col("id"), part, seed).alias("_at"), F.lit(0).alias("_law"), F.col("id").alias("trial"))
    merged = law.unionByName(wanted)
    below = F.sum("_law").over(Window.orderBy("_at", "_law").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = merged.withColumn(part, F.least(F.lit(high), F.lit(low) + below))
    return found.filter("_law = 0").select("trial", part)


def _binomial(spark: SparkSession, trials: int, seed: int, part: str, n: int, p: float) -> DataFrame:
    k = F.col("k")
    ratio = (F.lit(n) - k) / (k + 1.0) * F.lit(p / (1 - p) if p < 1 else 0.0)
    return _drawn(spark, trials, seed, part, 0, n, n * p, math.sqrt(n * p * (1 - p)), ratio)


def _hypergeometric(spark: SparkSession, trials: int, seed: int, part: str, good: int, bad: int, taken: int) -> DataFrame:
    k, n = F.col("k"), good + bad
    mean = taken * good / n if n else 0.0
    std = math.sqrt(mean * (bad / n) * ((n - taken) / (n - 1))) if n > 1 else 0.0
    ratio = (F.lit(good) - k).cast("double") * (F.lit(taken) - k) / ((k + 1.0) * (F.lit(bad - taken) + k + 1))
    return _drawn(spark, trials, seed, part, max(0, taken - bad), min(good, taken), mean, std, ratio)


def _trial_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return out.withColumn("f1", f1_of("precision", "recall"))


def random_trials(counts: Row, spark: SparkSession, trials: int = 1000, seed: int = 42) -> DataFrame:
    """F1 of ``trials`` classifiers that flag each session with the share of anomalies as chance.

    Given the class counts the hits of a trial are two binomial numbers, whatever the size.
    """
    n1, n0 = counts["tp"] + counts["fn"], counts["fp"] + counts["tn"]
    p = n1 / max(1, n1 + n0)
    both = _binomial(spark, trials, seed, "tp", n1, p).join(_binomial(spark, trials, seed, "fp", n0, p), "trial")
    return _trial_f1(both.withColumn("fn", F.lit(n1) - F.col("tp")))


def random_baseline(detections: DataFrame, trials: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and deviation of the random F1, distance of the model in sigmas, improvement, verdict."""
    spark, row = detections.sparkSession, confusion(detections).first()
    table = spark.createDataFrame([row], COUNTS)
    drawn = random_trials(row, spark, trials, seed)
    out = drawn.agg(F.avg("f1").alias("random_f1_mean"), F.stddev_pop("f1").alias("random_f1_std"))
    out = out.join(F.broadcast(class_metrics(table).select(F.col("f1").alias("model_f1"))))
    gap = F.col("model_f1") - F.col("random_f1_mean")
    return out.withColumns(
        {
            "sigma_above": ratio(gap, F.col("random_f1_std")),
            "improvement_pct": 100.0 * ratio(gap, F.col("random_f1_mean")),
            "passed": gap > 3 * F.col("random_f1_std"),
        }
    )


def permutation_trials(counts: Row, spark: SparkSession, trials: int = 1000, seed: int = 42) -> DataFrame:
    """F1 of the fixed predictions under shuffled labels: the hits of a shuffle are a hypergeometric number."""
    n1, n0, flagged = counts["tp"] + counts["fn"], counts["fp"] + counts["tn"], counts["tp"] + counts["fp"]
    hits = _hypergeometric(spark, trials, seed, "tp", n1, n0, flagged)
    return _trial_f1(hits.withColumns({"fp": F.lit(flagged) - F.col("tp"), "fn": F.lit(n1) - F.col("tp")}))


def permutation_test(detections: DataFrame, trials: int = 1000, seed: int = 42) -> DataFrame:
    """Mean, deviation and best shuffled F1, and the share of shuffles at least as good as the model."""
    spark, row = detections.sparkSession, confusion(detections).first()
    model = class_metrics(spark.createDataFrame([row], COUNTS)).select(F.col("f1").alias("model_f1"))  # one row
    shuffled = permutation_trials(row, spark, trials, seed).join(F.broadcast(model))
    out = shuffled.agg(
        F.avg("f1").alias("permuted_f1_mean"),
        F.stddev_pop("f1").alias("permuted_f1_std"),
        F.max("f1").alias("permuted_f1_best"),
        F.max("model_f1").alias("model_f1"),
        F.avg((F.col("f1") >= F.col("model_f1")).cast("double")).alias("p_value"),
    )
    return out.withColumn("passed", F.col("p_value") < 0.001)
