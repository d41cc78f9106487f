import math

import numpy as np
import pytest
from pyspark.sql import Row
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows_of
from vigilseq.functions import numeric as num
from vigilseq.operators import evaluate, leadtime, stats

# Published counts of the large benchmark: TP, FP, TN, FN.
COUNTS = (13855, 733, 55090, 2983)


def counts(spark, tp, fp, tn, fn):
    return spark.createDataFrame([(tp, fp, tn, fn)], "tp long, fp long, tn long, fn long")


def test_published_metrics(spark):
    row = evaluate.class_metrics(counts(spark, *COUNTS)).first()
    found = [round(row[n], 4) for n in ("precision", "recall", "f1", "accuracy", "specificity")]
    assert found == [0.9498, 0.8228, 0.8818, 0.9489, 0.9869]


def test_metrics_of_nothing_are_zero(spark):
    row = evaluate.class_metrics(counts(spark, 0, 0, 0, 0)).first()
    assert [row[n] for n in ("precision", "recall", "f1", "accuracy", "specificity")] == [0.0] * 5


def expand(spark, tp, fp, tn, fn, scale=1):
    groups = [(1, 1, tp), (0, 1, fp), (0, 0, tn), (1, 0, fn)]
    parts = [
        spark.range(n // scale).select(F.lit(label).alias("label"), F.lit(hit).alias("predicted")) for label, hit, n in groups
    ]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return df.withColumn("session_id", F.monotonically_increasing_id())


def test_published_trivial_baselines(spark):
    row = evaluate.trivial_baselines(expand(spark, *COUNTS)).first()
    assert round(row["all_positive_f1"], 4) == 0.3763 and row["majority_f1"] == 0.0
    assert round(row["majority_accuracy"], 4) == 0.7683 and row["passed"]


def test_published_auroc_from_u():
    assert round(854562189.5 / (55823 * 16838), 4) == 0.9092


def test_ksigma(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "max_loss double")
    assert evaluate.ksigma_threshold(df, 8.0).first()["threshold"] == 10.0
    assert round(0.016817706 + 8 * 0.033688825, 6) == 0.286328


SCORED = [(0, 0.0)] * 30 + [(1, 0.0)] * 4 + [(0, 0.5), (0, 0.5), (1, 0.5), (1, 0.9), (0, 0.9), (1, 2.0), (1, 3.0)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(SCORED, "label int, score double")


def slow_auroc(pairs):
    ones, zeros = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    u = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    return u, u / (len(ones) * len(zeros))


def test_rank_statistics_with_ties(scored):
    u, auroc = slow_auroc(SCORED)
    row = stats.rank_test(scored, "score", "label").first()
    assert (row["u"], row["auroc"]) == (u, pytest.approx(auroc))
    assert stats.roc_auc(scored, "score", "label").first()[0] == pytest.approx(auroc)


def test_pr_curve_has_one_point_per_score(scored):
    points = stats.pr_curve(scored, "score", "label").orderBy(F.desc("score")).collect()
    assert [p["score"] for p in points] == [3.0, 2.0, 0.9, 0.5, 0.0]
    recall, precision = [p["recall"] for p in points], [p["precision"] for p in points]
    area = np.trapezoid(precision, recall)
    for shuffled in (scored, scored.repartition(5).orderBy(F.rand(1))):
        assert stats.auprc(shuffled, "score", "label").first()[0] == pytest.approx(area)


def test_ks_and_effect(scored):
    ones, zeros = ([s for y, s in SCORED if y == label] for label in (1, 0))
    cdf = lambda v, x: sum(a <= x for a in v) / len(v)
    wanted = max(abs(cdf(ones, x) - cdf(zeros, x)) for x in ones + zeros)
    assert stats.ks(scored, "score", "label").first()["ks"] == pytest.approx(wanted)
    pooled = math.sqrt((np.std(ones) ** 2 + np.std(zeros) ** 2) / 2)
    row = stats.cohens_d(scored, "score", "label").first()
    assert row["d"] == pytest.approx((np.mean(ones) - np.mean(zeros)) / pooled) and row["effect"] == "LARGE"
    welch = stats.welch(scored, "score", "label").first()
    error = math.sqrt(np.var(ones, ddof=1) / len(ones) + np.var(zeros, ddof=1) / len(zeros))
    assert welch["t"] == pytest.approx((np.mean(ones) - np.mean(zeros)) / error)


def test_p_values(spark):
    one = spark.range(1)
    assert one.select(stats.normal_upper(F.lit(1.959964))).first()[0] == pytest.approx(0.025, abs=1e-6)
    assert one.select(stats.t_two_sided(F.lit(2.0), F.lit(10.0))).first()[0] == pytest.approx(0.0733880, abs=1e-6)
    assert one.select(stats.t_two_sided(F.lit(-12.706205), F.lit(1.0))).first()[0] == pytest.approx(0.05, abs=1e-6)
    assert one.select(stats.ks_upper(F.lit(1.358099))).first()[0] == pytest.approx(0.05, abs=1e-5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=40))
def test_auroc_ignores_monotone_maps(spark, pairs):
    pairs = pairs + [(0, 1), (1, 2)]
    df = spark.createDataFrame(pairs, "label int, score int").withColumn("score", F.col("score").cast("double"))
    _, wanted = slow_auroc(pairs)
    for column in (F.col("score"), F.exp("score") * 3 - 1):
        found = stats.rank_test(df.withColumn("score", column), "score", "label").first()["auroc"]
        assert found == pytest.approx(wanted)


def test_sweep_is_strict_and_counts_every_row(scored):
    rows = evaluate.threshold_sweep(scored, "score", "label", [0.0, 0.5, 2.0]).orderBy("grid_no").collect()
    assert [(r["tp"], r["fp"], r["tn"], r["fn"]) for r in rows] == [(4, 3, 30, 4), (3, 1, 32, 5), (1, 0, 33, 7)]


def test_calibration_takes_the_first_best(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 1.0)], "label int, score double")
    assert evaluate.calibrate(df, "score", "label", [0.5, 1.0, 1.5, 1.9]).first()["threshold"] == 1.0
    assert evaluate.calibrate_k(df, "score", "label", [0.0, 1.0]).first()["k_sigma"] == 0.0


def test_robust_range_reports_holes(spark):
    sweep = spark.createDataFrame([(0, 0.1, 0.8), (1, 0.2, 0.6), (2, 0.5, 0.9), (3, 0.9, 0.2)], "grid_no int, threshold double, f1 double")
    row = evaluate.robust_range(sweep).first()
    assert (row["robust_min"], row["robust_max"], row["holes"], row["passed"]) == (0.1, 0.5, 1, True)


def test_published_random_and_permuted_f1(spark):
    found = expand(spark, *COUNTS)
    by_law = stats.random_baseline(found, 300).first()
    assert by_law["random_f1_mean"] == pytest.approx(0.2319, abs=0.001)
    assert by_law["random_f1_std"] == pytest.approx(0.0030, abs=0.0006)
    shuffled = stats.permutation_test(found, 300).first()
    assert shuffled["permuted_f1_mean"] == pytest.approx(0.2151, abs=0.001)
    assert shuffled["permuted_f1_std"] == pytest.approx(0.0029, abs=0.0006)
    assert shuffled["p_value"] == 0.0 and shuffled["passed"]


def test_hits_follow_their_laws(spark):
    draw = np.random.default_rng(5)
    counts = evaluate.confusion(expand(spark, 30, 10, 40, 20)).first()
    drawn = stats.random_trials(counts, spark, 4000)
    for name, n in (("tp", 50), ("fp", 50)):
        found = np.array([r[name] for r in drawn.select(name).collect()])
        assert abs(found.mean() - n / 2) < 0.3 and abs(found.std() - np.sqrt(n) / 2) < 0.2
    hits = np.array([r["tp"] for r in stats.permutation_trials(counts, spark, 4000).collect()])
    wanted = draw.hypergeometric(50, 50, 40, 100_000)
    assert abs(hits.mean() - wanted.mean()) < 0.2 and abs(hits.std() - wanted.std()) < 0.1


def test_shuffle_keeps_the_class_sizes(spark):
    counts = evaluate.confusion(expand(spark, 30, 10, 40, 20)).first()
    for row in stats.permutation_trials(counts, spark, 20).collect():
        assert row["tp"] + row["fn"] == 50 and row["tp"] + row["fp"] == 40 and 0 <= row["tp"] <= 40


def test_one_class_only(spark):
    for cells in ((0, 3, 7, 0), (4, 0, 0, 2), (0, 0, 0, 0)):
        counts = Row(**dict(zip(("tp", "fp", "tn", "fn"), cells)))
        n1, flagged = cells[0] + cells[3], cells[0] + cells[1]
        assert {(r["tp"], r["fn"]) for r in stats.random_trials(counts, spark, 5).collect()} == {(n1, 0)}
        assert {r["tp"] + r["fp"] for r in stats.permutation_trials(counts, spark, 5).collect()} == {flagged}


def test_counts_above_a_billion(spark):
    counts = Row(tp=2 * 10**9, fp=10**9, tn=6 * 10**9, fn=10**9)
    hits = np.array([r["tp"] for r in stats.permutation_trials(counts, spark, 400).collect()], float)
    mean, n = 3e9 * 0.3, 1e10
    std = np.sqrt(mean * 0.7 * (n - 3e9) / (n - 1))
    assert abs(hits.mean() - mean) < 5 * std / 20 and 0.8 < hits.std() / std < 1.2
    first = np.array([r["tp"] for r in stats.random_trials(counts, spark, 400).collect()], float)
    assert abs(first.mean() - mean) < 5 * np.sqrt(mean * 0.7) / 20


def test_sweep_of_an_unsorted_grid(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.6, 1), (1.2, 0), (2.5, 1)], "score double, label int")
    up = {r["threshold"]: r["f1"] for r in evaluate.threshold_sweep(rows, "score", "label", [0.5, 2.0]).collect()}
    down = {r["threshold"]: r["f1"] for r in evaluate.threshold_sweep(rows, "score", "label", [2.0, 0.5]).collect()}
    assert up == down and len(up) == 2


# -- lead time ----------------------------------------------------------------

LEADS = [-1.0, 0.0, 0.5, 1.0, 10.0, 60.0, 480.0, 1440.0, None]


@pytest.fixture
def found(spark):
    rows = [(f"s{i}", 1, 1, lead, "c" if i % 2 else "d") for i, lead in enumerate(LEADS)]
    rows += [("fn", 1, 0, None, "c"), ("fp", 0, 1, 5.0, "Other"), ("tn", 0, 0, None, "Other")]
    return spark.createDataFrame(rows, "session_id string, label int, predicted int, lead_min double, category string")


def test_four_disjoint_outcomes(found):
    row = leadtime.lead_outcome(found).first()
    assert (row["n_tp"], row["anticipated"], row["simultaneous"], row["reactive"], row["unknown"]) == (9, 6, 1, 1, 1)


def test_lead_statistics(found):
    leads = [v for v in LEADS if v is not None]
    row = leadtime.lead_stats(found).first()
    assert row["median_min"] == np.median(leads) and row["std_min"] == pytest.approx(np.std(leads, ddof=1))
    early = leadtime.lead_stats(found, positive_only=True).first()
    assert (early["n"], early["min_min"]) == (6, 0.5)


def test_bands_add_up(found):
    rows = leadtime.lead_bands(found).orderBy("band_no").collect()
    assert [r["band"] for r in rows] == num.OPENSTACK_BANDS
    assert [r["count"] for r in rows] == [0, 2, 1, 1, 2, 1, 1]
    assert sum(r["pct"] for r in rows) == pytest.approx(100)


def test_leads_by_category(spark, found):
    rows = leadtime.lead_by_category(found.withColumn("steps_before_error", F.lit(1))).collect()
    assert [r["category"] for r in rows] == ["c", "d"]
    assert {r["category"]: r["median_min"] for r in rows} == {"c": 30.5, "d": 5.25}


def test_best_and_worst(found):
    assert [r["lead_min"] for r in leadtime.best_leads(found, 2).collect()] == [1440.0, 480.0]
    assert [r["lead_min"] for r in leadtime.worst_leads(found, 2).collect()] == [-1.0, 0.0]


def test_end_and_error_leads_differ(spark):
    row = [("s", 1, 1, 0, 60, 10, 20, 1, 2, 4)]
    names = "session_id string, label int, predicted int, a long, b long, c long, d long, alert_pos long, first_error_pos long, n_events long"
    df = spark.createDataFrame(row, names)
    for name, column in (("start_ts", "a"), ("end_ts", "b"), ("alert_ts", "c"), ("first_error_ts", "d")):
        df = df.withColumn(name, F.timestamp_seconds(column))
    assert leadtime.lead_to_end(df).first()["lead_min"] == pytest.approx(50 / 60)
    exact = leadtime.lead_to_first_error(df)
    assert exact.first()["lead_sec"] == pytest.approx(10)
    assert leadtime.steps_before_error(df).first()["steps_before_error"] == 1
    assert leadtime.lead_or_estimate(exact).first()["lead_used_min"] == pytest.approx(10 / 60)
    without = exact.withColumn("lead_min", F.lit(None).cast("double"))
    assert leadtime.lead_or_estimate(without).first()["lead_used_min"] == pytest.approx((20 - 15) / 60)


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    rows = leadtime.histogram(df, "v", 10).orderBy("bin_no").collect()
    assert [r["count"] for r in rows] == [10] * 9 + [11]
    assert leadtime.histogram(df, "v", 10, clip=(0.01, 0.99)).agg(F.sum("count")).first()[0] == 99
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert rows_of(leadtime.histogram(flat, "v", 10)) == [(0, 3.0, 3.0, 2)]


def test_reports_of_missed_and_false(found):
    sized = found.withColumns({"n_events": F.lit(2), "alert_loss": F.lit(0.5)})
    assert rows_of(evaluate.fn_report(sized)) == [("c", 1, 2.0, 100.0)]
    row = evaluate.fp_report(sized).first()
    assert (row["n_fp"], row["loss_median"], row["pct_of_normal"]) == (1, 0.5, 50.0)
    report = {r["category"]: (r["total"], r["detected"], r["missed"]) for r in evaluate.category_report(sized).collect()}
    assert report == {"c": (5, 4, 1), "d": (5, 5, 0)}
