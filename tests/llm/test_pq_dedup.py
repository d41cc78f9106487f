import math
import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from vigilseq.llm import pq_dedup
from vigilseq.llm.common import local_roots

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, times string, list int"


def brute_force(rows, cosine):
    good = []
    for i, (key, v) in enumerate(rows):
        fine = key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(fine)
    left, right = [], []
    links = [0] * len(rows)
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if g else None for (_, v), g in zip(rows, good)]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                left.append(i)
                right.append(j)
    root = local_roots(len(rows), np.array(left, int), np.array(right, int))
    least = {}
    for (key, _), r in zip(rows, root):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, links[i], least.get(root[i]) if good[i] else key) for i, (key, _) in enumerate(rows)]


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA)
    return [tuple(r) for r in pq_dedup.near_vectors(docs, **more).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def vectors(seed, n=200, size=13):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 8, size))
    rows = [centres[i % len(centres)] + draw.normal(size=size) * draw.choice([0.0, 0.1, 0.3, 2.0]) for i in range(n)]
    return [(int(k), v.astype(np.float32).tolist()) for k, v in zip(draw.permutation(n), rows)]


EDGES = [
    (1000, None), (1001, []), (1002, [0.0] * 13), (1003, [1.0, None] + [0.0] * 11), (1004, [math.nan] + [1.0] * 12),
    (1005, [math.inf] + [1.0] * 12), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0, 2.0]), (1008, [1e-30, 2e-30]), (1009, [3e38, 3e38]),
]


@pytest.mark.parametrize("more", [{}, {"block_rows": 7}, {"lists": 1}, {"lists": 60, "block_rows": 3}])
def test_complete_with_the_radius_as_margin(spark, more):
    rows = vectors(1) + EDGES
    rows += [rows[3], rows[4], (2000, rows[5][1])]
    got = found(spark, rows, margin=math.sqrt(0.1), **more)
    assert ordered(got) == ordered(brute_force(rows, 0.95))


def test_other_lengths_do_not_narrow_the_search(spark):
    """Planted pairs of short vectors are found beside one long vector and pairs of it."""
    draw = np.random.default_rng(9)
    rows, links = [], 0
    for size, n in ((32, 150), (1024, 4), (7, 40)):
        for _ in range(n):
            one = draw.normal(size=size)
            other = one + draw.normal(size=size) * 0.2
            for v in (one, other):
                rows.append((len(rows), v.astype(np.float32).tolist()))
    wanted = brute_force(rows, 0.95)
    links = sum(r[1] for r in wanted)
    got = found(spark, rows)
    assert all(g[1] <= w[1] for g, w in zip(ordered(got), ordered(wanted)))
    assert links >= 300 and sum(r[1] for r in got) >= 0.97 * links


def test_nothing_to_compare(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")
def test_recall_of_the_default_margin(spark):
    table = pq.read_table(f"{FOLDER}/embeddings.parquet")
    unit = np.array(table.column("embedding").to_pylist(), np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    wanted = dict(zip(table.column("vec_id").to_pylist(), ((unit @ unit.T) >= 0.95).sum(1) - 1))
    got = {r["id"]: r["n_links"] for r in pq_dedup.near_vectors(spark.read.parquet(f"{FOLDER}/embeddings.parquet")).collect()}
    assert set(got) == set(wanted) and all(got[k] <= wanted[k] for k in got)
    assert sum(got.values()) >= 0.99 * sum(wanted.values())
