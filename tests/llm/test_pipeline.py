"""Every stage of the pipeline against a plain version, on the stage's own input."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontamination import every_window
from tests.llm.test_language import plain_score
from tests.llm.test_simhash import plain_fingerprint
from vigilseq.llm import language, mixing
from vigilseq.llm.common import local_roots
from vigilseq.sources.staging import stage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")


def plain_language(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    languages, model = language.train(language.label_rows(docs))
    verdict = plain_score([(r[0], r[1], r[2], r[3]) for r in rows], languages, model)
    return [r for r, (_, lang, posterior) in zip(rows, verdict) if lang != "und" and posterior >= language.ACCEPT and any(c.isalpha() for c in r[1] or "")]


def plain_duplicates(spark, rows):
    prints = np.array([plain_fingerprint(r[1]) for r in rows], np.uint64)
    left, right = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    groups = {}
    for row, root in zip(rows, local_roots(len(rows), left, right)):
        groups[root] = min(groups.get(root, row), row, key=lambda r: r[0])
    return list(groups.values())


def plain_decontamination(spark, rows):
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect()]
    hit = {key for key, _ in every_window(items, [(r[0], r[1]) for r in rows])}
    return [r for r in rows if r[0] not in hit]


def plain_mixing(spark, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].encode())
    weights = {s: n**mixing.TEMPERING for s, n in sizes.items()}
    rates = {s: w / sum(weights.values()) * sum(sizes.values()) / sizes[s] for s, w in weights.items()}
    table = spark.createDataFrame([(r[0], r[1], rates[r[3]]) for r in rows], "doc_id bigint, text string, rate double")
    drawn = table.select("doc_id", mixing.poisson(F.col("rate"), [F.lit(17), F.col("doc_id"), F.xxhash64("text")]).alias("k"))
    times = {r["doc_id"]: r["k"] for r in drawn.collect()}
    return [r for r in rows for _ in range(times[r[0]])]


PLAIN = dict(zip(("language", "near_duplicates", "decontamination", "mixing"), (plain_language, plain_duplicates, plain_decontamination, plain_mixing)))


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(function(spark, docs, FOLDER), "test")
        assert docs.columns == columns
        assert Counter(tuple(r) for r in docs.collect()) == Counter(PLAIN[name](spark, before)), name
    rows = docs.count()
    found = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    sizes = Counter()
    for r in found:
        assert r["size"] == len(r["text"].encode()) + 8
        sizes[r["shard"]] += r["size"]
    assert len(found) == rows and max(sizes) < corpus_pipeline.SHARDS
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in found)


def test_run_and_edge_rows(spark, tmp_path):
    clashing = ("_row", "_text", "_times", "rate", "shard")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashing)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "%% 12", "en", None, 5)]
    rows += [(i, f"the words of the text number {i} are here to be kept {i * 7} and so on", "en", "s", 50) for i in range(10, 30)]
    rows += [rows[-1], (None, rows[5][1], "en", "s", 50)]
    rows = [(*r, *[f"{c} of {r[0]}" for c in clashing]) for r in rows]
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r["doc_id"] >= 10 and all(r[c] == f"{c} of {r['doc_id']}" for c in clashing[:-1]) for r in out)
    assert all(r["shard"] in range(corpus_pipeline.SHARDS) for r in out)
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
