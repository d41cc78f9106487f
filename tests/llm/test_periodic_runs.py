import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilseq.llm import periodic_runs
from vigilseq.llm.catalog import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Maximal stretches of every period, kept at the smallest one."""
    found = {}
    n = len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(24, 3 * p):
                found.setdefault((start, length), p)
    return sorted((s, length, p) for (s, length), p in found.items())


def turned(key, words):
    if key is None:
        return words
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def brute_row(key, text):
    words = turned(key, WORD.findall(text or ""))
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(collapsed))


def random_words(draw, alphabet):
    words = draw.integers(0, alphabet, draw.integers(0, 60)).tolist()
    for _ in range(draw.integers(0, 4)):
        period = draw.integers(0, alphabet, draw.integers(1, 12)).tolist()
        words += (period * 12)[: draw.integers(0, 80)] + draw.integers(0, alphabet, draw.integers(0, 9)).tolist()
    return words


@pytest.mark.parametrize("alphabet", [1, 2, 3, 40])
def test_runs_equal_brute_force(alphabet):
    draw = np.random.default_rng(alphabet)
    documents = [random_words(draw, alphabet) for _ in range(150)]
    found = periodic_runs.find_runs([np.array(d, np.int64) for d in documents])
    for words, runs in zip(documents, found):
        assert [tuple(r) for r in runs.tolist()] == brute_runs(words)


def test_candidates_without_runs():
    words = np.arange(60)
    words[30] = words[9]
    assert [len(r) for r in periodic_runs.find_runs([words, words[:5]])] == [0, 0]


def test_extensions_are_exact():
    draw = np.random.default_rng(5)
    words = np.concatenate([np.tile(draw.integers(0, 3, 50), 30), draw.integers(0, 3, 500), np.zeros(300, int), [7], np.zeros(400, int)])
    words = np.concatenate([[100], words, [101]])
    grammar = periodic_runs.build_grammar(words)
    left = draw.integers(1, len(words) - 1, 4000)
    right = draw.integers(1, len(words) - 1, 4000)
    apart = left < right
    left, right = left[apart], right[apart]

    def agree(i, j, step):
        n = 0
        while words[i] == words[j]:
            i, j, n = i + step, j + step, n + 1
        return n

    assert periodic_runs.extend(grammar, left, right).tolist() == [agree(i, j, 1) for i, j in zip(left, right)]
    assert periodic_runs.extend(grammar, left, right, ahead=False).tolist() == [agree(i, j, -1) for i, j in zip(left, right)]


def test_grammar_is_shallow_on_repetitive_words():
    words = np.concatenate([[9], np.tile([0, 1], 100_000), [8]])
    grammar = periodic_runs.build_grammar(words)
    assert len(grammar.symbols) < 10 * len(words)
    assert periodic_runs.extend(grammar, np.array([1]), np.array([3])).tolist() == [199_998]


def test_query_equals_brute_force(spark, tmp_path):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in random_words(draw, 3)) for _ in range(120)]
    texts += ["", None, " \t\n", "ein ein  ein\tein\x0bein\x0c" * 8, "ä b " * 30, "x", texts[5], "a b c " * 4000 + "d e " * 5000]
    rows = [(i if i != 7 else None, t, 1) for i, t in enumerate(texts)]
    rows += [(3, "a b " * 20, 1), (3, "a b " * 20, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op13_recompression_runs"](spark, folder).collect()]
    wanted = [brute_row(k, t) for k, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[6:])
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_columns_and_empty_table(spark):
    schema = "doc_id bigint, text string, best string, n int, _text string"
    docs = spark.createDataFrame([(1, "a " * 30, "mine", 5, "kept")], schema)
    found = periodic_runs.collapse_runs(docs).collect()
    clashing = periodic_runs.collapse_runs(docs.select("doc_id", "text", F.lit(2).alias("text_")).withColumnsRenamed({"text": "body", "text_": "text"}), "body")
    assert [(r["text"], r["collapsed"]) for r in clashing.collect()] == [(2, "a")]
    assert [r.asDict(True) for r in found] == [
        {"doc_id": 1, "n": 5, "_text": "kept", "n_words": 30, "runs": [{"start": 0, "length": 30, "period": 1}], "best": {"start": 0, "length": 30, "period": 1}, "collapsed": "a"}
    ]
    assert periodic_runs.document_runs(docs.limit(0)).collect() == []
