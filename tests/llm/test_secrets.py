import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from vigilseq.llm import secrets

FOLDER = "/root/testdata/sf0.001"
NAMES = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_force(text):
    text = text or ""
    assign = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = sorted(assign + access + hexes)
    added = []
    for kind, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(c.pattern, text):
            if re.search(secrets.IDENTIFIER, m[0]):
                continue
            spans = []
            blanked = re.sub("(?i)" + "|".join(secrets.PLACEHOLDERS), lambda word: secrets.BLANK * len(word[0]), m[0])
            for at in range(len(m[0]) - secrets.WINDOW + 1):
                window = blanked[at : at + secrets.WINDOW]
                entropy = -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in Counter(window).values())
                allowed = not re.search("[0-9]", window) or not re.search("[A-Za-z]", window) or secrets.BLANK in window
                if entropy >= c.bits - 1e-9 and not allowed:
                    begin, end = m.start() + at, m.start() + at + secrets.WINDOW
                    if spans and spans[-1][1] >= begin:
                        spans[-1][1] = end
                    else:
                        spans.append([begin, end])
            added += [(b, kind, e) for b, e in spans if not any(x[0] <= b and e <= x[2] for x in base)]

    def joined(spans):
        return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    return len(assign), len(access), len(hexes), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, parts string")
    found = [tuple(r) for r in secrets.secrets(docs).collect()]
    wanted = [(i, *brute_force(t)) for i, t in rows]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    return wanted


PICK = random.Random(5)
RANDOM = "".join(PICK.choice(secrets.CLASSES[1].alphabet) for _ in range(300))
HEXES = "".join(PICK.choice("0123456789abcdef") for _ in range(90))
TEXTS = [
    None,
    "",
    "no secrets here, thousands of thingsthatarelongbutwordsonlyreally",
    "password = hunter2hunter2 PassWD:'abc' é𝒳 api_key=\"AAAAbbbb1111\" Token: x",
    "token=api_key: abcdefghij secret=secret=secret==",
    "AKIAIOSFODNN7ABCDEF AKIAAKIA123 xAKIA0123456789AB",
    "𝒳𝒳 0123456789abcdef0123456789abcdef 0123456789abcdef0123456789abcde deadbeef",
    f"x {RANDOM[:40]} y {RANDOM[40:70]}, {RANDOM} aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1",
    "\u0001key\u0001 token: \u0001 secret: abcdefgh\u0001\u0002 token=12345678",
    "3F2504E0AA4F89D39A0CAAB305E82C33 550e8400-e29b-41d4-a716-446655440000",
    " ".join(f"token=v{i}xxyyzz" for i in range(400)),
    "a1" * 5000 + RANDOM,
    RANDOM * 7 + "x" * 490 + RANDOM,
    f"{RANDOM[:40]}/sample/{RANDOM[60:100]} {RANDOM[:30]}Example{RANDOM[30:60]}",
    f"key-{HEXES[:28]} sk_{HEXES[30:60].upper()} /x/{HEXES[60:84]}/y z{HEXES[:30]}",
    f"{RANDOM[:18]}0000{RANDOM[18:40]} {RANDOM[40:60]}xxxx{RANDOM[60:80]}",
    "K" + "token=12345678 ſecret=12345678",
]


def test_equals_brute_force(spark):
    wanted = check(spark, [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[4])])
    assert any("entropy_base64" in w[-1] for w in wanted) and any("entropy_hex" in w[-1] for w in wanted)


def test_allow_list_frees_windows_only(spark):
    """Random strings beside a placeholder, behind a sign or with four equal characters are found."""
    texts = [f"{RANDOM[:40]}/sample/{RANDOM[60:100]}", f"key-{HEXES[:28]}", f"{RANDOM[:18]}0000{RANDOM[18:40]}", "ab-sample-123456789012345678"]
    spans = [w[-1] for w in check(spark, list(enumerate(texts)))]
    assert spans[0].count("entropy_base64") == 2 and "entropy_hex:4:32" in spans[1] and "entropy_base64" in spans[2] and spans[3] == ""


def test_a_run_of_a_megabyte(spark):
    long = (RANDOM + "words" * 60) * (1_000_000 // 600)
    started = time.monotonic()
    rows = spark.createDataFrame([(1, long[:100_000]), (2, long)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.secrets(rows).collect()}
    assert found[1] == brute_force(long[:100_000])[-1] and found[2].startswith(found[1].rsplit(",", 1)[0])
    assert time.monotonic() - started < 120


def test_empty(spark):
    check(spark, [])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")
def test_given_documents(spark):
    table = pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()
    check(spark, list(zip(table["doc_id"], table["text"])))
