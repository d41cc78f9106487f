import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilseq.llm import token_alignment
from vigilseq.llm.catalog import QUERIES
from vigilseq.llm.token_counts import FOLDER, load_vocabulary

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tokenizer files not found")
WHOLE = []  # the library's own reading of the byte-level file, loaded once
GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools():
    return token_alignment.Tokenizers(load_vocabulary(FOLDER, token_alignment.BYTE_LEVEL), load_vocabulary(FOLDER, token_alignment.PIECES))


def whole_tokens(text, tools):
    """Ids and end offsets of both sides, the whole text encoded at once; None if the bytes differ."""
    whole = Tokenizer.from_file(f"{FOLDER}/{token_alignment.BYTE_LEVEL}") if not WHOLE else WHOLE[0]
    whole.encode_special_tokens = True
    WHOLE[:] = [whole]
    ids = whole.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    found = []
    for own, spelled in zip(ids, (tools.a_bytes, tools.b_bytes)):
        if b"".join(spelled[i] for i in own) != (" " + text).encode():
            return None
        found.append((own, np.cumsum([len(spelled[i]) for i in own]).tolist()))
    return found


def plain_groups(text, tools):
    """Groups as pairs of id lists."""
    found = whole_tokens(text, tools) if text else None
    if not found:
        return []
    (a, ends_a), (b, ends_b) = found
    groups, start_a, start_b = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        stop_a, stop_b = ends_a.index(end, start_a) + 1, ends_b.index(end, start_b) + 1
        groups.append((a[start_a:stop_a], b[start_b:stop_b]))
        start_a, start_b = stop_a, stop_b
    return groups


def plain_rows(rows, tools):
    groups = [plain_groups(t, tools) for _, t in rows]
    links = [Counter((x, y) for a, b in own for x in a for y in b) for own in groups]
    held = Counter(pair for own in links for pair in own)
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (key, _), own, linked in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((
            key, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(linked.values()),
            sum(n for p, n in linked.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return out


EDGES = [
    "", None, " ", "   ", "\n\n a  b \n ", "x" * 3000, "Straße über  Çödé  x", "日本語 テキスト 😀👩‍👩‍👧", "a ▁ b", "▁", "<|endoftext|> <s> </s> <0x41> <unk>",
    "it's we'll  I'd 1234567 3.14", "tab\tnew\x0bline\r\nend ", "\x00\x1c \x85 z", "a   b　c", "word " * 50, "é ́ x", "ab​ cd", "a _ b . c",
]


def random_texts(seed, n):
    draw = np.random.default_rng(seed)
    letters = list("abcdeéß漢 Z9_.,'-\n\t   😀▁")
    weights = np.array([1.0] * (len(letters) - 1) + [0.02])
    return ["".join(draw.choice(letters, draw.integers(1, 120), p=weights / weights.sum())) for _ in range(n)]


def test_parts_are_encoded_like_the_whole(tools):
    texts = [t for t in EDGES if t] + random_texts(1, 1500)
    a, b, kept = token_alignment.encode(texts, tools)
    for i, text in enumerate(texts):
        found = whole_tokens(text, tools)
        assert kept[i] == (found is not None), repr(text)
        for side, tokens in enumerate((a, b)):
            assert tokens.ids[tokens.text == i].tolist() == (found[side][0] if found else []), repr(text)


def test_ranks_give_the_ids_of_the_file(tools):
    """Letters of all kinds, alone, beside digits, doubled, behind an apostrophe and before a line's end."""
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x20000, 7)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" a{c}b {c}{c} 1{c}2{c} {c}'s{c}\n{c}" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    whole = Tokenizer.from_file(f"{FOLDER}/{token_alignment.BYTE_LEVEL}")
    whole.encode_special_tokens = True
    assert tools.a(texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_overlaps_are_all_pairs_that_share_a_byte(tools):
    texts = random_texts(2, 60)
    a, b, _ = token_alignment.encode(texts, tools)
    over_a, over_b = token_alignment.overlaps(a, b)
    wanted = (a.start[:, None] < b.end[None, :]) & (b.start[None, :] < a.end[:, None])
    assert sorted(zip(over_a.tolist(), over_b.tolist())) == list(zip(*(x.tolist() for x in np.nonzero(wanted))))


def test_query_equals_plain_version(spark, tmp_path, tools):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(EDGES + random_texts(3, 80))]
    rows += [rows[6], (6, EDGES[6]), (900, EDGES[7])]
    rows += [(1000 + i, r["text"]) for i, r in enumerate(spark.read.parquet(f"{GIVEN}/documents.parquet").limit(40).collect())]
    folder = str(tmp_path)
    spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id bigint, text string, pairs int").write.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    wanted = sorted(plain_rows(rows, tools), key=key)
    assert sorted((tuple(r) for r in QUERIES["op12_asof_token_alignment"](spark, folder).collect()), key=key) == wanted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for frequent in (0, 50):  # all pairs, or the less frequent ones, are joined
        assert sorted((tuple(r) for r in token_alignment.document_alignment(docs, frequent=frequent).collect()), key=key) == wanted


def test_long_text_and_large_groups(monkeypatch, tools):
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", 400)
    monkeypatch.setattr(token_alignment, "LINKS", 10)
    for text in [" ".join(random_texts(4, 40)), "x" * 2000 + " y" * 300, "a ▁ b " * 200]:
        found = token_alignment.align_document(text, tools)
        groups = plain_groups(text, tools)
        assert ";".join(found.groups) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        links = Counter(x * len(tools.b_bytes) + y for a, b in groups for x in a for y in b)
        assert dict(zip(found.pairs.tolist(), found.times.tolist())) == links
        assert found.counts.tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values())]


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("a b", 1, 2, "x")], "text string, n_a int, _row int, text_ string")
    found = token_alignment.align_documents(docs)
    assert found.columns == ["_row", "text_", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    assert found.select("_row", "n_a", "n_groups").collect() == [(2, 2, 2)]
    assert token_alignment.document_alignment(docs.limit(0).withColumn("doc_id", F.lit(1))).collect() == []
