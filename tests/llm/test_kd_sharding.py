import zlib

import pytest
from pyspark.sql import functions as F

from vigilseq.llm import kd_sharding as kd

SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, size int"


def brute_force(rows, shards):
    """The same tree over lists: rows are (row, size, numbers per dimension)."""
    spans = [(min(r[2][d] for r in rows), max(r[2][d] for r in rows)) for d in range(len(rows[0][2]))]
    scaled = [(r[0], r[1], [(x - lo) / (hi - lo) if hi > lo else 0.0 for x, (lo, hi) in zip(r[2], spans)]) for r in rows]
    out = {}

    def cut(part, first, n):
        if n == 1 or not part:
            out.update((r[0], first) for r in part)
            return
        widths = [max(r[2][d] for r in part) - min(r[2][d] for r in part) for d in range(len(spans))]
        axis = widths.index(max(widths))
        total, before, half, sides = sum(r[1] for r in part), 0, n // 2, ([], [])
        for r in sorted(part, key=lambda r: (r[2][axis], r[0])):
            sides[(before + r[1] / 2) * n > total * half].append(r)
            before += r[1]
        cut(sides[0], first, half)
        cut(sides[1], first + half, n - half)

    cut(scaled, 0, shards)
    return out


@pytest.fixture
def docs(spark):
    rows = [(i, "same" if i % 3 == 0 else "x" * (i * 37 % 500), "en", "hot" if i % 3 else "s", "clash", 1) for i in range(900)]
    return spark.createDataFrame(rows, SCHEMA)


def sums(found):
    out = {}
    for r in found:
        out.setdefault(r["shard"], []).append(r)
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 24])
def test_equals_brute_force(spark, shards):
    rows = [(i, float(i * 7919 % 101), float(i % 10)) for i in range(300)]
    table = spark.createDataFrame(rows, "id bigint, a double, b double").coalesce(1)
    found = kd.kd_shards(table, F.col("id") % 13 + 1, ["a", "b"], shards).collect()
    # Rows of one partition are numbered in order.
    wanted = brute_force([(i, i % 13 + 1, [a, b]) for i, a, b in rows], shards)
    assert {r["id"]: r["shard"] for r in found} == wanted


def test_bytes_are_near_equal_and_slots_have_no_gaps(spark, docs):
    found = kd.document_shards(docs, 24).collect()
    parts = sums(found)
    assert sorted(parts) == list(range(24)) and len(found) == 900
    sizes = [sum(r["size"] for r in part) for part in parts.values()]
    assert max(sizes) - min(sizes) <= 2 * 508
    for part in parts.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in found)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 8 for r in found)


def test_all_rows_equal(spark):
    rows = [(7, "same text", None, None, None, None)] * 100
    parts = sums(kd.document_shards(spark.createDataFrame(rows, SCHEMA), 24).collect())
    assert sorted(map(len, parts.values())) == [4] * 20 + [5] * 4


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", None, None), (2, "é" * 50_000, "fr", "s", None, None)]
    found = kd.document_shards(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert sorted(r["size"] for r in found) == [8, 8, 100_008]
    assert len(found) == 3 and all(0 <= r["shard"] < 24 for r in found)
    assert kd.document_shards(spark.createDataFrame([], SCHEMA), 24).collect() == []


def test_target_bytes(spark, docs):
    found = kd.kd_shards(docs, kd.text_size(), ["doc_id"], target_bytes=20_000).collect()
    total = sum(r["size"] for r in found)
    assert len({r["shard"] for r in found}) == -(-total // 20_000)
    with pytest.raises(ValueError):
        kd.kd_shards(docs, kd.text_size(), ["doc_id"])


def test_no_python_on_the_executors(docs):
    plan = kd.document_shards(docs, 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
