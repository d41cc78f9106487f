import hashlib
import random

import numpy as np
import pytest

from vigilseq.llm import substring_dedup as dedup
from vigilseq.llm.fm_index import FMIndex, matching_windows

SCHEMA = "doc_id bigint, text string, spans int"


def brute_force(rows, window):
    """Every window against all windows before it; repeated (id, text) rows are one document."""
    texts = sorted({(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows})
    seen, removed = set(), {}
    for key, text in texts:
        words = text.split()
        gone = np.zeros(len(words), bool)
        for at in range(len(words) - window + 1):
            one = tuple(words[at : at + window])
            if one in seen:
                gone[at : at + window] = True
            seen.add(one)
        removed[key, text] = words, gone
    out = []
    for i, t in rows:
        words, gone = removed[-(2**63) if i is None else i, (t or "").encode()]
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, kept.decode(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, window=20, **more):
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    found = [tuple(r) for r in dedup.remove_repeats(docs, window=window, **more).collect()]

    def key(r):
        return (r[0] is None, r[0] or 0, r[4])

    assert sorted(found, key=key) == sorted(brute_force(rows, window), key=key)


def corpus(seed, words=40, documents=60, length=120):
    pick = random.Random(seed)
    passages = [" ".join(f"w{pick.randrange(words)}" for _ in range(pick.randrange(15, 50))) for _ in range(6)]
    rows = []
    for i in range(documents):
        parts = []
        while len(" ".join(parts).split()) < pick.randrange(1, length):
            parts.append(pick.choice(passages) if pick.random() < 0.4 else f"u{i} w{pick.randrange(words)}")
        rows.append((i * 3, "\n ".join(parts)))
    return rows


EDGES = [(None, None), (None, "a b c " * 20), (1000, ""), (1001, " \t "), (1002, "same " * 400), (1003, "é nbsp  x" * 50)]


def test_equals_brute_force(spark):
    rows = corpus(1) + EDGES
    check(spark, rows + [rows[5], rows[9], (1002, "other text of the same id " * 9), (1010, rows[7][1])])


@pytest.mark.parametrize("more", [{"hot_rows": 128}, {"shard_words": 300}, {"hot_rows": 128, "shard_words": 300}])
def test_common_anchors_and_small_shards(spark, more, monkeypatch):
    monkeypatch.setattr(dedup, "SAMPLE", 2)
    rows = corpus(2, words=5, documents=80) + EDGES
    check(spark, rows, **more)


def test_small_window(spark):
    check(spark, corpus(3, words=4), window=7, anchor=2)


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("depth", [1, 2, 5, 20])
def test_index_matches(depth):
    pick = np.random.default_rng(depth)
    lengths = pick.integers(0, 60, 15)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    values = pick.integers(0, 2, offsets[-1]).astype(np.uint64) * np.uint64(9)
    index = FMIndex(values, offsets, depth)
    windows = {}
    for s in range(15):
        for at in range(offsets[s], offsets[s + 1] - depth + 1):
            windows.setdefault(tuple(values[at : at + depth]), []).append(at + s)
    other = np.where(pick.random(400) < 0.02, 5, pick.integers(0, 2, 400) * 9).astype(np.uint64)
    for queries, bounds in ((values, offsets), (other, np.array([0, 100, 250, 250, 400]))):
        found = {int(p): sorted(index.order[a:b].tolist()) for p, a, b in zip(*matching_windows(index, queries, bounds))}
        wanted = {}
        for s in range(len(bounds) - 1):
            for at in range(bounds[s], bounds[s + 1] - depth + 1):
                if tuple(queries[at : at + depth]) in windows:
                    wanted[at] = sorted(windows[tuple(queries[at : at + depth])])
        assert found == wanted
