import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vigilseq.llm import ppm

SCHEMA = "doc_id bigint, text string"


def brute_force(rows, order):
    """Plain trie with escapes and exclusions, byte by byte over the whole text."""

    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    def held(key):
        return key is not None and zlib.crc32(str(key).encode()) % 5 == 1

    counts = Counter(t for key, text in rows if not held(key) for t in tokens(text))
    seen = defaultdict(Counter)

    def stream(text):
        return b" " + b"".join(word + b" " for word in tokens(text))

    for key, text in rows:
        if not held(key):
            data = stream(text)
            for i in range(1, len(data)):
                for k in range(min(i, order) + 1):
                    seen[data[i - k : i]][data[i]] += 1

    def byte(context, symbol):
        excluded, lp = set(), 0.0
        while context and not seen.get(context):
            context = context[1:]
        while True:
            left = {s: n for s, n in seen.get(context, {}).items() if s not in excluded}
            total, kinds = sum(left.values()), len(left)
            if len(seen.get(context, {})) == ppm.SYMBOLS:
                kinds = 0
            if symbol in left:
                return lp + math.log10(left[symbol] / (total + kinds))
            if left:
                lp += math.log10(kinds / (total + kinds))
            excluded |= set(left)
            if not context:
                return lp - math.log10(ppm.SYMBOLS - len(excluded))
            context = context[1:]

    def text_score(text):
        data = stream(text)
        return sum(byte(data[max(0, i - order) : i], data[i]) for i in range(1, len(data)))

    n, v = sum(counts.values()), len(counts)
    out = []
    for key, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        known = sum(counts[t] > 0 for t in own)
        out.append((key, held(key), len(own), known, n, base, text_score(text)))
    return out


def scored(spark, rows, order=3, **more):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", lp string, cnt int")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return [tuple(r) for r in ppm.score_documents(docs, held_out, order=order, **more).collect()]


def same(found, wanted):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], r[6])

    assert len(found) == len(wanted)
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


ROWS = [(i, f"The cat{'s' * (i % 3)} sat on the MAT é{i % 7} and  the\tdog{i % 11}") for i in range(30)]
EDGES = [(100, None), (101, ""), (102, " \n\x0b "), (103, "x" * 5000), (104, " nbsp  q\x00z"), (None, "lost id"), (3, ROWS[3][1])]


@pytest.mark.parametrize("order", [0, 1, 3, 6])
def test_scores_like_brute_force(spark, order):
    rows = ROWS + EDGES
    same(scored(spark, rows, order), brute_force(rows, order))


def test_small_chunks_give_the_same(spark):
    rows = ROWS + EDGES
    same(scored(spark, rows, chunk_words=5, buckets=3), brute_force(rows, 3))


def test_small_steps_give_the_same(monkeypatch):
    monkeypatch.setattr(ppm, "GRAM_BYTES", 40)
    monkeypatch.setattr(ppm, "GRAM_ROWS", 10)
    counts = ppm.GramCounts(5)
    bodies = [ppm.body((text or "").encode().lower().split()) for _, text in ROWS]
    for i, one in enumerate(bodies):
        counts.add(one, i % 3 == 0)
    gram, n = counts.close()
    wanted = Counter({int(g): 0 for g in ppm.running_grams(bodies, 5)[1]})
    wanted.update(ppm.running_grams([b for i, b in enumerate(bodies) if i % 3], 5)[1].tolist())
    assert dict(zip(gram.tolist(), n.tolist())) == wanted


def test_the_order_of_words_counts(spark):
    rows = [(i, "the cat sat on the mat") for i in range(20)] + [(900, "the cat sat on the mat"), (901, "mat the on sat cat the")]
    found = {r[0]: r for r in scored(spark, rows, 5)}
    assert found[900][5] == found[901][5] and found[900][6] > found[901][6] + 1


@pytest.mark.parametrize("order", range(7))
def test_grams_reach_back_to_the_beginning(order):
    bodies = [b"ab c ", b"", b"xyzuvw "]
    of, gram = ppm.running_grams(bodies, order)
    wanted = []
    for number, one in enumerate(bodies):
        data = b" " + one + b" "
        for i in range(1, len(data)):
            k = min(i, order)
            wanted.append((number, k << ppm.LENGTH_AT | int.from_bytes(data[i - k : i + 1], "big")))
    assert list(zip(of.tolist(), gram.tolist())) == wanted


def test_nothing_to_learn_from_and_empty(spark):
    held = [(i, "a b a") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    same(scored(spark, held), brute_force(held, 3))
    assert scored(spark, []) == []


def test_probabilities_of_a_context_add_up_to_one():
    """In the brute force, which the operator equals, all bytes and the closing space share one."""
    rows = [(0, "ab abc b"), (2, "ba")]
    one_letter = [bytes([b]) for b in range(256) if bytes([b]).split()]
    known = brute_force(rows, 2)
    assert len(known) == 2 and len(one_letter) + 1 == ppm.SYMBOLS
