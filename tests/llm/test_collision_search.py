import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilseq.llm import collision_search

SCHEMA = "vec_id bigint, embedding array<float>, row int, rank string, size int"


def plain(rows, wanted=5, every=50):
    """Exact answers; sums in the order of the numbers, like the operator's."""
    good = []
    for place, (key, v) in enumerate(rows):
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            scale = 2.0 ** -math.frexp(max(map(abs, v)))[1]
            v = [x * scale for x in v]
            good.append((key, place, v, math.sqrt(sum_in_order(v, v))))
    found = []
    for key, place, v, norm in good:
        if key % every:
            continue
        others = [(-sum_in_order(v, w) / (norm * n), k, p) for k, p, w, n in good if p != place and len(w) == len(v)]
        found += [(key, rank, k, -score) for rank, (score, k, p) in enumerate(sorted(others)[:wanted], 1)]
    return sorted(found)


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def answers(spark, rows, **more):
    table = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collision_search.nearest_vectors(table, F.col("vec_id") % 50 == 0, **more).collect())


def vectors(seed, n, size=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(max(1, n // 20), size))
    rows = [centres[i % len(centres)] + draw.normal(size=size) * draw.choice([0.0, 0.05, 0.4, 3.0]) for i in range(n)]
    return [(int(k), v.astype(np.float32).tolist()) for k, v in zip(draw.permutation(n), rows)]


EDGES = [
    (5000, None), (5001, []), (5050, [0.0] * 16), (5100, [1.0, None] + [0.0] * 14), (5150, [math.nan] + [1.0] * 15), (5200, [math.inf] + [1.0] * 15),
    (5250, [1.0, 2.0]), (5251, [2.0, 4.0]), (5252, [-1.0, 0.5]), (None, [1.0, 2.0]), (5300, [1e-30, 2e-30]), (5350, [3e38, 3e38]), (5400, [1.0, 2.0, 3.0]),
]


@pytest.mark.parametrize("more", [{}, {"block_numbers": 1, "query_numbers": 1}])
def test_recall_and_edge_rows(spark, more):
    rows = vectors(1, 1500) + EDGES
    rows += [(50, rows[3][1]), (50, rows[3][1]), (rows[9][0], rows[9][1]), (6000, rows[9][1])]
    got, wanted = answers(spark, rows, **more), plain(rows)
    assert len(got) == len(wanted)
    pairs = [{(q, v, s) for q, _, v, s in found} for found in (got, wanted)]
    assert len(pairs[0] & pairs[1]) >= 0.97 * len(pairs[1])
    small = [r for r in got if r[0] in (5250, 5300, 5350, 5400)]
    assert small == [r for r in wanted if r[0] in (5250, 5300, 5350, 5400)]


def test_many_copies_come_by_id(spark):
    draw = np.random.default_rng(2)
    one = draw.normal(size=16).astype(np.float32).tolist()
    rows = [(i, one if i % 3 else draw.normal(size=16).astype(np.float32).tolist()) for i in range(1, 2000)] + [(100000, one)]
    got = [r for r in answers(spark, rows, block_numbers=1) if r[0] in (50, 100000)]
    assert got == [r for r in plain(rows) if r[0] in (50, 100000)]
    assert [r[2] for r in got if r[0] == 100000] == [1, 2, 4, 5, 7]


def test_nothing_to_search(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(0, [1.0]), (1, None)]) == []
    assert answers(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_a_search_reads_few_vectors_where_neighbours_are_near():
    """Windows stay narrow for a query with copies around it; without a bound for others all vectors would be verified."""
    draw = np.random.default_rng(3)
    near = draw.normal(size=64)
    rows = np.concatenate([near + 0.01 * draw.normal(size=(20, 64)), draw.normal(size=(2000, 64))])
    block = collision_search.Block(np.arange(len(rows)), np.arange(len(rows)), rows)
    unit = near / np.linalg.norm(near)
    low, high = block.windows(unit[None, :])
    places, _ = block.nearest(low[0], high[0], unit, -1, -2.0, 5)
    assert 5 <= len(places) <= 20
    far = draw.normal(size=64)
    low, high = block.windows(far[None, :] / np.linalg.norm(far))
    assert len(block.nearest(low[0], high[0], far / np.linalg.norm(far), -1, 0.99, 5)[0]) == 0
