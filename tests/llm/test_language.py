import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigilseq.llm import language

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, best int, host string"
WORDS = {"aa": ["lorva", "mintel", "quos", "drelm"], "bb": ["ßtark", "wöhn", "zilpf", "grünk"], "cc": ["ñoqui", "tarado", "lluev", "cío"]}


def rows_of_languages(n, seed=1):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        lang = pick.choice("aa aa aa bb cc".split())
        out.append((i, " ".join(pick.choice(WORDS[lang]) for _ in range(pick.randrange(1, 30))), lang, f"{lang}.host" if i % 4 else "mixed", 9, "clash"))
    return out


def plain_score(rows, languages, model):
    """Posterior per row by plain counting."""
    classes = len(languages) + 1
    ll, best = [], []
    for _, text, *_ in rows:
        data = [x if 97 <= x <= 122 or x >= 128 else 32 for x in (text or "").encode().lower()]
        data = [32, 32, *data, 32, 32]
        total, letters = np.zeros(classes), 0
        for a, b, c in zip(data, data[1:], data[2:]):
            if b != 32:
                slot = ((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 16
                total += model[slot].astype(float)
                letters += 1
        ll.append(total * language.TEXT_WEIGHT)
        best.append(int(total.argmax()) if letters else -1)
    votes = Counter(b for b in best if b >= 0)
    whole = [(votes[c] + 1) / (sum(votes.values()) + classes) for c in range(classes)]
    hosts, declared = defaultdict(Counter), defaultdict(Counter)
    for (_, _, lang, source, *_), b in zip(rows, best):
        if b >= 0 and source is not None:
            hosts[source][b] += 1
        if b >= 0 and lang is not None:
            declared[lang][b] += 1
    domain = Counter()
    for c in hosts.values():
        domain += c
    k = language.STRENGTH
    domain = [(domain[c] + k * whole[c]) / (sum(domain.values()) + k) for c in range(classes)]
    per_class = [sum(d[c] for d in declared.values()) for c in range(classes)]
    out = []
    for (key, _, lang, source, *_), l, b in zip(rows, ll, best):
        own = Counter(hosts[source]) if source is not None else Counter()
        if b >= 0 and source is not None:
            own[b] -= 1
        prior = domain if source is not None and source in hosts and sum(hosts[source].values()) else whole
        score = [l[c] + math.log((own[c] + k * prior[c]) / (sum(own.values()) + k)) for c in range(classes)]
        if lang in declared and sum(declared[lang].values()):
            share = sum(declared[lang].values()) / sum(per_class)
            score = [s + math.log((declared[lang][c] + k * share) / (per_class[c] + k)) for c, s in enumerate(score)]
        odds = np.exp(np.array(score) - max(score))
        out.append((key, [*languages, "und"][int(np.argmax(score))], 1 / odds.sum()))
    return out


def test_fusion_equals_plain_counting(spark):
    rows = rows_of_languages(200) + [(900, None, "aa", None, 1, ""), (901, "", None, "mixed", 1, ""), (902, "123 %%", "bb", "new", 1, ""), (903, "жук " * 9, None, None, 1, ""), (None, "lorva", "xx", "mixed", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    languages, model = language.train(language.label_rows(docs))
    found = language.identify(language.document_evidence(docs, "doc_id"), languages, model).collect()
    wanted = {w[0]: w for w in plain_score(rows, languages, model)}
    assert len(found) == len(rows)
    for r in found:
        _, lang, posterior = wanted[r["doc_id"]]
        assert r["lang"] == lang and r["posterior"] == pytest.approx(posterior, rel=1e-4), r
    verdict = {r["doc_id"]: r["accepted"] for r in found}
    assert not any(verdict[k] for k in (900, 901, 902, 903))
    clean = [r["accepted"] for r in found if r["doc_id"] is not None and r["doc_id"] < 200]
    assert sum(clean) == 200


def test_page_evidence(spark):
    rows = [
        (1, "https://a.b.Example.FR:80/x", '<!DOCTYPE html><html class="x" lang="fr-CA"><script>var t="<p>";</script><p>le&amp;la</p>'),
        (2, "http://localhost", "<HTML LANG=en><!-- no --><b>the</b>"),
        (3, None, None),
        (4, "not an address", "text only"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in language.page_evidence(pages, "page_id").collect()}
    assert [found[1][c] for c in ("declared", "suffix", "host", "domain")] == ["fr", "fr", "a.b.example.fr", "example.fr"]
    assert found[1]["text"].split() == ["le", "la"]
    assert [found[2][c] for c in ("declared", "suffix", "host", "domain")] == ["en", "localhost", "localhost", "localhost"]
    assert [found[4][c] for c in ("declared", "suffix", "host", "domain")] == [None] * 4
    assert found[3]["text"] == "" and found[3]["declared"] is None


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "lorva", None, "s", 1, "")], SCHEMA)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert [r["accepted"] for r in language.documents_and_pages(docs, pages).collect()] == [False]
    assert language.documents_and_pages(docs.limit(0), pages).collect() == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not found")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    languages, model = language.train(language.label_rows(docs.filter("doc_id % 2 = 0")))
    hidden = docs.filter("doc_id % 2 = 1").withColumnRenamed("lang", "true").selectExpr("*", "cast(null as string) as lang")
    found = language.identify(language.document_evidence(hidden, "doc_id", "true"), languages, model).collect()
    assert sum(r["lang"] == r["true"] for r in found) >= 0.97 * len(found)


def test_rare_languages_and_texts_with_many_copies(spark):
    """A language of one row is known beside many others, and copies of one text do not fill the sample."""
    rows = [(f"lorva {i} mintel", "aa") for i in range(300)] + [("ßtark wöhn", "bb")] * 600 + [(f"wöhn zilpf {i}", "bb") for i in range(30)] + [("ñoqui", "cc")]
    languages, model = language.train(spark.createDataFrame(rows, "text string, label string"), sample=30)
    assert languages == ["aa", "bb", "cc"] and model.shape[1] == 4
    once, again = (language.train(spark.createDataFrame(x, "text string, label string"), sample=30)[1] for x in (rows, sorted(set(rows))))
    assert np.array_equal(once, again)


def test_no_labels(spark):
    languages, model = language.train(spark.createDataFrame([("a", None)], "text string, label string"))
    assert languages == [] and model.shape[1] == 1
