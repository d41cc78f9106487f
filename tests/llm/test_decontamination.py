import os
import random

import numpy as np
import pytest

from vigilseq.llm import decontamination as dc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, item_id string, block int"
WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "to"] * 60


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(5))
def test_common_subsequence(seed):
    pick = random.Random(seed)
    a, b = ([pick.randrange(6) for _ in range(pick.randrange(1, 90))] for _ in range(2))
    assert dc.common_subsequence(a, b) == lcs(a, b)


def corpus(seed=1):
    pick = random.Random(seed)
    items = [" ".join(pick.choice(WORDS) for _ in range(pick.randrange(14, 60))) for _ in range(30)]
    docs, planted = [], set()
    for i in range(150):
        words = [f"{pick.choice(WORDS)}x" if pick.random() < 0.5 else pick.choice(WORDS) for _ in range(pick.randrange(1, 400))]
        if i % 3 == 0:
            item = pick.randrange(30)
            copy = items[item].split()
            if i % 2:  # some words changed, not in the answer
                for _ in range(len(copy) // 6):
                    copy[pick.randrange(len(copy) * 2 // 3)] = "other"
            at = pick.randrange(len(words) + 1)
            words[at:at] = [w.upper() + pick.choice(["", ",", "."]) for w in copy]
            planted.add((i, item))
        docs.append((i, "\n ".join(words)))
    return items, docs, planted


def every_window(items, docs):
    """The same decision on all windows, without retrieval."""
    out = set()
    split = [dc.plain_words([t.encode().lower()])[0].tolist() for t in items]
    for key, text in docs:
        words = dc.plain_words([(text or "").lower().encode()])[0].tolist()
        for n, item in enumerate(split):
            if len(item) < dc.MIN_WORDS:
                continue
            for at in range(0, max(1, len(words)), dc.STEP):
                for size in dc.SIZES:
                    span = words[max(0, at - dc.STEP) : at + size * dc.STEP + dc.STEP]
                    if span and dc.is_leak(*dc.overlap(item, span)):
                        out.add((key, n))
    return out


def leaks(spark, items, docs):
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(items)], "item_id bigint, text string, _row string")
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    return {(r["id"], r["item_id"]) for r in dc.find_leaks(table, benchmark.drop("_row")).collect()}


def test_planted_passages_are_found_and_nothing_else(spark):
    items, docs, planted = corpus()
    assert leaks(spark, items, docs) == planted
    assert planted <= every_window(items, docs)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 7)
    items, docs, planted = corpus(2)
    assert leaks(spark, items, docs) == planted


def test_edge_rows(spark):
    items, docs, _ = corpus(3)
    items += [items[0], "", "too short item"]
    docs = [(1, None), (2, ""), (3, items[0]), (3, items[0]), (None, items[0]), (4, "too short item " * 5), (5, "word " * 50_000 + items[1])]
    benchmark = spark.createDataFrame([*enumerate(items), (99, None)], "item_id bigint, text string")
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    found = sorted(((r["id"], r["item_id"]) for r in dc.find_leaks(table, benchmark).collect()), key=str)
    assert found == sorted([(3, 0), (3, 0), (3, 30), (3, 30), (None, 0), (None, 30), (5, 1)], key=str)
    assert dc.find_leaks(table, benchmark.limit(0)).collect() == []
    assert dc.find_leaks(table.limit(0), benchmark).collect() == []
    nothing = benchmark.filter("item_id = 99")
    assert dc.find_leaks(table, nothing).collect() == []


def test_space_keeps_the_rows_of_a_small_benchmark(spark):
    items, docs, _ = corpus(4)
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    features = dc.fit_weights(spark.createDataFrame([(t,) for _, t in docs], "text string"), dc._vocabulary(benchmark))
    rows = dc._rows([t.encode() for t in items], features)
    low = rows @ dc.fit_space(benchmark, features)
    assert np.abs(low @ low.T - rows @ rows.T).max() < 1e-4


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = {(r["id"], r["item_id"]) for r in dc.find_leaks(docs, benchmark).collect()}
    texts = [r["text"] for r in benchmark.orderBy("item_id").collect()]
    assert found == every_window(texts, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
