import os

import pytest

from vigilseq.llm import token_counts as tc

pytestmark = pytest.mark.skipif(not os.path.isdir(tc.FOLDER), reason="vocabularies not found")
SCHEMA = "doc_id bigint, text string, length int"


def docs(spark):
    texts = [None, "", "a", "Hello world, hello", "é𝒳" * 700, "x " * 3000, "tie", "tie", " \n\t " * 10, "<|endoftext|>"]
    return texts, spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], SCHEMA)


def test_histogram_answers_every_limit(spark):
    texts, table = docs(spark)
    encode = tc.encoder(tc.load_vocabulary()).encode_ordinary
    sizes = [len(encode(t or "")) for t in texts]
    found = tc.token_histogram(table)
    rows = {r["length"]: r for r in found.collect()}
    assert sorted(rows) == sorted(set(sizes))
    for length, r in rows.items():
        assert r["n_docs"] == sizes.count(length)
        assert r["docs_up_to"] == sum(s <= length for s in sizes) and r["docs_above"] == sum(s > length for s in sizes)
        assert r["tokens_up_to"] == sum(s for s in sizes if s <= length) and r["tokens_above"] == sum(s for s in sizes if s > length)
        assert r["truncated_tokens"] == sum(min(s, length) for s in sizes)
        assert r["quantile"] == pytest.approx(r["docs_up_to"] / len(sizes))
    limits = [0, 1, 2, 7, 1023, 1024, 10**6]
    for r in tc.at_limits(found, limits).collect():
        assert r["docs_above"] == sum(s > r["context"] for s in sizes)
        assert r["tokens"] == sum(sizes) and r["truncated_tokens"] == sum(min(s, r["context"]) for s in sizes)
    for r in tc.length_at(found, [0.1, 0.5, 1.0]).collect():
        assert sum(s <= r["length"] for s in sizes) >= r["quantile"] * len(sizes) > sum(s < r["length"] for s in sizes)


def test_empty(spark):
    _, table = docs(spark)
    assert tc.token_histogram(table.limit(0)).collect() == []
