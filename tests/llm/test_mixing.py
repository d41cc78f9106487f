import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from vigilseq.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, rate string, copy_no int"


@pytest.fixture
def docs(spark):
    rows = [(i, f"text {i} " * (1 + i % 5), "hot" if i % 3 == 0 else f"s{i % 4}", "clash", 5) for i in range(6000)]
    return spark.createDataFrame(rows, SCHEMA)


def pmf(mean, n):
    return math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))


@pytest.mark.parametrize("mean", [0.3, 1.0, 7.9, 30.0])
def test_draws_follow_the_law(spark, mean):
    n = 40_000
    drawn = spark.range(n).select(mixing.poisson(F.lit(mean), [F.lit(3), F.col("id")]).alias("k"))
    found = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
    # Chi-square over the values with enough expected draws.
    values = [k for k in range(200) if n * pmf(mean, k) >= 5]
    square = sum((found.get(k, 0) - n * pmf(mean, k)) ** 2 / (n * pmf(mean, k)) for k in values)
    assert square < len(values) + 5 * math.sqrt(2 * len(values))
    assert abs(sum(k * c for k, c in found.items()) / n - mean) < 5 * math.sqrt(mean / n)


def test_inverts_the_uniform_exactly(spark):
    rows = spark.range(500).select(
        F.xxhash64(F.lit(1), F.lit(3), "id").alias("h"), mixing.poisson(F.lit(2.5), [F.lit(3), F.col("id")]).alias("k")
    )
    for h, k in rows.collect():
        uniform = (((h % 2**64) >> 11) + 0.5) / 2**53
        total, wanted = pmf(2.5, 0), 0
        while total < uniform:
            wanted += 1
            total += pmf(2.5, wanted)
        assert wanted == k


def test_shares_meet_the_weights(spark, docs):
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s1", 2.0), ("s2", 4.0), ("s3", 0.0)], "source string, weight double")
    out = mixing.replicate(docs, weights)
    sizes = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert "s3" not in sizes
    for source, weight in (("hot", 1), ("s0", 1), ("s1", 2), ("s2", 4)):
        assert sizes[source] / sum(sizes.values()) == pytest.approx(weight / 8, rel=0.1)


def test_same_rows_for_any_partitioning_and_join(spark, docs):
    first = rows_of(mixing.replicate(docs).select("doc_id", "copy_no", "rate"))
    assert rows_of(mixing.replicate(docs.repartition(3)).select("doc_id", "copy_no", "rate")) == first
    assert rows_of(mixing.replicate(docs, broadcast_sources=0).select("doc_id", "copy_no", "rate")) == first
    times = {}
    for key, copy, _ in first:
        times.setdefault(key, []).append(copy)
    assert all(sorted(c) == list(range(len(c))) for c in times.values())


def test_order_is_shuffled(spark, docs):
    ids = [r["doc_id"] for r in mixing.replicate(docs).select("doc_id").collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 0.45 < rising / len(ids) < 0.55


def test_edge_rows(spark):
    rows = [(1, None, None, None, None), (None, "x", None, None, None), (2, "", "empty", None, None), (3, "y" * 100_000, "long", None, None)]
    out = mixing.replicate(spark.createDataFrame(rows + rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "source", "copy_no", "rate"]
    assert all(r["rate"] > 0 for r in out.collect())
    assert mixing.replicate(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_replicate(rows, hashes, seed=17):
    """(doc_id, copy_no, rate) by plain sums and inversion; ``hashes`` are the engine's, by (part, id)."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode())
    weights = {s: n**mixing.TEMPERING for s, n in sizes.items()}
    total, out = sum(sizes.values()), []
    for key, _, source in rows:
        rate = weights[source] / sum(weights.values()) * total / sizes[source]
        parts = max(1, math.ceil(rate / mixing.MOST_PER_DRAW))
        times = 0
        for part in range(1, parts + 1):
            uniform = (((hashes[part, key] % 2**64) >> 11) + 0.5) / 2**53
            p = reached = math.exp(-rate / parts)
            k = 0
            while reached < uniform:
                k += 1
                p *= rate / parts / k
                reached += p
                times += 1
        out += [(key, copy, rate) for copy in range(times)]
    return out


def test_equals_a_plain_version(spark):
    rows = [(i, f"text {i} " * (1 + i % 5), "hot" if i % 3 else f"s{i % 40}") for i in range(900)] + [(900 + i, "x", "tiny") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    hashed = docs.select("doc_id", *[F.xxhash64(F.lit(part), F.lit(17), "doc_id", F.xxhash64("text")).alias(str(part)) for part in range(1, 200)])
    hashes = {(part, r["doc_id"]): r[str(part)] for r in hashed.collect() for part in range(1, 200)}
    got = sorted(tuple(r) for r in mixing.replicate(docs).select("doc_id", "copy_no", "rate").collect())
    wanted = sorted(plain_replicate(rows, hashes))
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in wanted])


@pytest.mark.parametrize("limit", [100, 0])
def test_columns_keep_their_values(spark, limit):
    names = ["_source", "_salt", "_of", "_text", "_times", "_place", "_Text_"]
    docs = spark.createDataFrame([(1, "some text", "a", *names)], ["doc_id", "text", "source", *names])
    found = mixing.replicate(docs, spark.createDataFrame([("a", 1.0)], ["source", "weight"]), broadcast_sources=limit, seed=3)
    assert found.columns == [*docs.columns, "copy_no", "rate"]
    assert all([r[n] for n in names] == names for r in found.collect()) and found.count()


def test_no_python_on_the_executors(docs):
    plan = mixing.replicate(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
