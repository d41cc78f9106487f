import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilseq.operators import sketches


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_merged_quantiles_keep_the_bound(spark, parts):
    draw = np.random.default_rng(parts)
    values = np.concatenate([draw.normal(size=30_000), draw.integers(0, 5, 20_000).astype(float), draw.exponential(100, 10_000)])
    rows = spark.createDataFrame([(float(v), "ab"[i % 3 == 0]) for i, v in enumerate(values)], "value double, kind string")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)))
    qs = {f"q{i}": i / 20 for i in range(21)}
    merged = sketches.merge_quantile_sketches(sketches.quantile_sketches(rows, "value", ["kind", "part"]), ["kind"])
    for row in sketches.sketch_quantiles(merged, qs).collect():
        own = np.sort([v for i, v in enumerate(values) if "ab"[i % 3 == 0] == row["kind"]])
        assert row["n"] == len(own)
        for name, q in qs.items():
            below, up_to = np.searchsorted(own, row[name], "left") / len(own), np.searchsorted(own, row[name], "right") / len(own)
            assert below - 2 * sketches.rank_error() <= q <= up_to + 2 * sketches.rank_error()


def test_nulls_and_empty_parts(spark):
    rows = spark.createDataFrame([(None, 1), (3.0, 2)], "value double, part int")
    found = sketches.sketch_quantiles(sketches.quantile_sketches(rows, "value", ["part"]), {"m": 0.5}).collect()
    assert [(r["part"], r["n"], r["m"]) for r in found] == [(2, 1, 3.0)]
    assert sketches.distinct_counts(sketches.distinct_sketches(rows, "value", ["part"])).collect() == [(2, 1)]


def test_overlap_of_sides_that_may_be_empty(spark):
    rows = spark.createDataFrame([(f"e{i}", i % 3, i % 5) for i in range(90)] + [("e0", 1, 0)], "event string, label int, part int")
    stored = sketches.distinct_sketches(rows, "event", ["label", "part"])
    found = sketches.sketch_overlap(stored, F.col("label") == 0, F.col("label") == 1).first()
    assert tuple(found) == (29, 30, 1)
    assert tuple(sketches.sketch_overlap(stored, F.col("label") == 0, F.col("label") == 9).first()) == (30, 0, 0)
    assert tuple(sketches.sketch_overlap(stored.limit(0), F.col("label") == 0, F.col("label") == 1).first()) == (0, 0, 0)


def test_large_distinct_counts_are_near(spark):
    rows = spark.range(60_000).selectExpr("cast(id % 50000 as string) event", "id % 9 part")
    merged = sketches.merge_distinct_sketches(sketches.distinct_sketches(rows, "event", ["part"]), [])
    assert abs(sketches.distinct_counts(merged).first()[0] - 50_000) <= 4 * 50_000 / 2 ** (sketches.LG_ENTRIES / 2)


@pytest.mark.parametrize("m", [1, 5, 40])
def test_no_frequent_event_is_missed(spark, m):
    draw = np.random.default_rng(m)
    names = [f"e{min(int(x), 199)}" for x in draw.exponential(12, 6_000)]
    days = draw.integers(0, 6, len(names)).tolist()
    rows = spark.createDataFrame([(n, d) for n, d in zip(names, days)] + [(None, 1)], "event string, day int")
    found = sketches.merge_summaries(sketches.frequent_summary(rows, ["day"], m), ["day"]).collect()
    exact, floor = Counter(names), found[0]["floor"]
    per_day = [sorted(Counter(n for n, d in zip(names, days) if d == day).values(), reverse=True) for day in range(6)]
    assert floor == sum(c[m] if len(c) > m else 0 for c in per_day)
    kept = {r["event"]: (r["lower"], r["upper"]) for r in found}
    assert all(low <= exact[e] <= high for e, (low, high) in kept.items())
    assert {e for e, n in exact.items() if n > floor} <= set(kept)
    assert math.isclose(sketches.rank_error(200), 0.0133, abs_tol=1e-4)
