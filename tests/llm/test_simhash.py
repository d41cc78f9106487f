import random

import numpy as np
import pytest
import xxhash

from vigilseq.llm import simhash
from vigilseq.llm.common import local_roots
from vigilseq.llm.components import components

SCHEMA = "doc_id bigint, text string, fp int, key string"


def plain_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def flipped(values, pick, most):
    out = []
    for v in values:
        for b in pick.sample(range(64), pick.randrange(most)):
            v ^= 1 << b
        out.append(v)
    return out


def plain_roots(fps):
    left, right = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    return local_roots(len(fps), left, right)


@pytest.fixture
def prints():
    pick = random.Random(3)
    base = [pick.getrandbits(64) for _ in range(60)]
    near = flipped(base * 6, pick, 8) + flipped([base[0]] * 400, pick, 6)
    fps = np.array(list({*base, *near}), np.uint64)
    return fps[np.random.default_rng(1).permutation(len(fps))]


def test_bit_sliced_comparisons_equal_brute_force(prints):
    wanted = plain_roots(prints)
    assert (simhash.block_links(prints) == wanted).all()
    assert (simhash.shift_links(prints, np.array([len(prints)])) == wanted).all()


def test_groups_do_not_mix(prints):
    starts = np.array([0, 3, 4, 300, 302])
    a, b = simhash.forest(prints, starts)
    place = {int(v): i for i, v in enumerate(prints)}
    left, right = (np.array([place[int(v)] for v in x], int) for x in (a, b))
    ends = np.append(starts[1:], len(prints))
    found = local_roots(len(prints), left, right)
    for s, e in zip(starts, ends):
        assert (found[s:e] - s == plain_roots(prints[s:e])).all()


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 40])
def test_links_connect_what_brute_force_connects(spark, prints, bucket_rows):
    signed = prints.view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bucket_rows)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    wanted = plain_roots(prints)
    groups = {}
    for v, w in zip(signed, wanted):
        groups.setdefault(w, []).append(v)
    for members in groups.values():
        assert len(members) == 1 and members[0] not in roots or {roots[m] for m in members} == {min(members)}


def test_documents(spark):
    pick = random.Random(5)
    texts = [" ".join(pick.choice("abcdefghij") * pick.randrange(1, 9) for _ in range(pick.randrange(0, 120))) for _ in range(60)]
    texts += [t.upper() + " one" for t in texts] + texts[:9] + [None, "", " \n\x0b", "a b c d", "A b", "nbsp x é𝒳  y z", "w " * 70_000]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[7]), (None, "only here without id at all ok")]
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    found = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    fps = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    least = {}
    roots = plain_roots(fps)
    for (key, _), root in zip(rows, roots):
        if key is not None:
            least[root] = min(least.get(root, key), key)
    wanted = [(key, format(int(f), "016x"), least.get(root)) for (key, _), f, root in zip(rows, fps, roots)]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 700)] + [(7, 7), (9, None), (800, 801), (801, 800)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    wanted = {i: 100 for i in range(100, 181)} | {i: 500 for i in range(500, 700)} | {800: 800, 801: 800}
    assert found == wanted
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
