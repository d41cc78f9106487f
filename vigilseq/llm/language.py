"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: byte trigrams of the letters under one distribution per language, and under a flat
  one that stands for no known language (``und``).
* Declared language: the ``lang`` attribute of the markup, or a column.
* Address suffix: the last label of the host name.
* Host: how often a language was best by text on the host, smoothed by its domain, which
  is smoothed by the whole table; the row's own vote is left out.

The languages are the labels of all rows.  The trigram model is fitted on at most ``SAMPLE``
distinct labelled texts, equally many of each language at most, drawn by hash.  All other
counts are grouped aggregations over all rows: likelihoods of the declared language and
of the suffix given the language, and the host priors.  They are written tables of one
row per value, sent to the executors when small and joined otherwise.

A row is accepted when the most probable class is a language with a posterior of at least
``ACCEPT`` and its text has letters.  Null and empty texts, and texts without letters, are
rejected; a missing declaration, address or host is no evidence.  Without labelled rows
no language is known and nothing is accepted.  Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.llm.common import look_up
from vigilseq.llm.words import text_parts
from vigilseq.sources.staging import stage

UNKNOWN = "und"
SAMPLE = 20_000  # distinct labelled texts that the trigram model is fitted on
MAX_LANGUAGES = 256
SLOTS = 1 << 16  # hashed trigrams
ADD = 0.05  # smoothing of a slot
STRENGTH = 20.0  # rows that a prior is worth
TEXT_WEIGHT = 0.3  # neighbouring trigrams are not independent
ACCEPT = 0.5

_FOLD = np.full(256, 32, np.uint32)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams with a letter in the middle, and where those of each text begin (one entry more)."""
    data = np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)
    letters = _FOLD[data]
    grams = letters[:-2] << np.uint32(16) | letters[1:-1] << np.uint32(8) | letters[2:]
    kept = np.flatnonzero(letters[1:-1] != 32)
    slots = (grams[kept] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = 2 + np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2) - 2
    return slots, np.concatenate(([0], np.searchsorted(kept + 1, ends)))


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (slots, languages + 1), from rows (text, label)."""
    flat = np.full((SLOTS, 1), -np.log(SLOTS))
    rows = labelled.filter("label is not null").withColumn("_draw", F.xxhash64("text", "label"))
    known = [r["label"] for r in rows.select("label").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages among the labels")
    if not known:
        return [], flat.astype(np.float32)
    # The least hashes of each language; equal texts are one draw, however often they occur.
    order = Window.partitionBy("label").orderBy("_draw")
    draws = rows.select("label", "_draw").distinct().withColumn("_rank", F.row_number().over(order))
    last = draws.filter(F.col("_rank") <= max(1, sample // len(known))).groupBy("label").agg(F.max("_draw").alias("_last"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for low, high, texts in text_parts(batch.column(1)):
                slots, starts = trigrams(texts)
                for i, label in enumerate(labels[low:high]):
                    own = held.setdefault(label, np.zeros(SLOTS, np.int64))
                    own += np.bincount(slots[starts[i] : starts[i + 1]], minlength=SLOTS)
        for label, own in held.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(slots)), pa.array(slots), pa.array(own[slots])], ["label", "slot", "n"])

    drawn = rows.join(F.broadcast(last), "label").filter(F.col("_draw") <= F.col("_last"))  # one row per language
    drawn = drawn.groupBy("label", "_draw").agg(F.first("text").alias("text")).select("label", "text")
    counted = drawn.mapInArrow(count, "label string, slot bigint, n bigint").groupBy("label", "slot").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # at most slots x languages
    languages = sorted(known)
    number = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((SLOTS, len(languages)))
    at = [number[x] for x in table.column("label").to_pylist()]
    counts[table.column("slot").to_numpy(), at] = table.column("n").to_numpy()
    fitted = np.log((counts + ADD) / (counts.sum(0) + ADD * SLOTS))
    return languages, np.concatenate((fitted, flat), axis=1).astype(np.float32)


def text_likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Replace ``text`` by ``ll`` (weighted log likelihood per class), ``best`` and ``letters``."""
    others = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, letters = np.zeros((n, model.shape[1])), np.zeros(n, np.int64)
            for low, high, texts in text_parts(batch.column("text")):
                slots, starts = trigrams(texts)
                letters[low:high] = np.diff(starts)
                some = np.flatnonzero(np.diff(starts))
                if len(some):
                    total[low + some] = np.add.reduceat(model[slots], starts[some], axis=0, dtype=np.float64)
            total *= TEXT_WEIGHT
            best = np.where(letters > 0, total.argmax(1), -1)
            values = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * model.shape[1], pa.array(total.ravel()))
            columns = [*[batch.column(c) for c in others], values, pa.array(best.astype(np.int32)), pa.array(letters)]
            yield pa.RecordBatch.from_arrays(columns, [*others, "ll", "best", "letters"])

    spec = ", ".join(f"`{c}` {kinds[c]}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, f"{spec}, ll array<double>, best int, letters bigint")


def _votes(classes: int) -> list[Column]:
    return [F.count_if(F.col("best") == i).alias(f"v{i}") for i in range(classes)]


def _array(classes: int, prefix: str = "v") -> Column:
    return F.array(*[F.col(f"{prefix}{i}").cast("double") for i in range(classes)])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _shares(rows: DataFrame, classes: int) -> list[float]:
    """Share of each class by text over the whole table, none of it zero."""
    votes = rows.agg(*_votes(classes)).first()
    return [(n + 1.0) / (sum(votes) + classes) for n in votes]


def _value_likelihood(rows: DataFrame, column: str, classes: int) -> DataFrame:
    """(column, name_l): log P(value | class) per value, smoothed towards the value's share."""
    known = rows.filter(F.col(column).isNotNull() & (F.col("best") >= 0))
    table = stage(known.groupBy(column).agg(*_votes(classes)), column)
    totals = table.agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0)) for i in range(classes)]).first()
    whole = float(max(1, sum(totals)))
    own = _array(classes)
    share = _sum(own) / whole
    below = F.array(*[F.lit(n + STRENGTH) for n in totals])
    return stage(
        table.select(column, F.zip_with(own, below, lambda n, t: F.log((n + STRENGTH * share) / t)).alias(f"{column}_l")), column
    )


def _host_votes(rows: DataFrame, classes: int) -> DataFrame:
    """(host, host_votes, domain_prior): votes of a host, and its domain's smoothed distribution."""
    known = rows.filter(F.col("host").isNotNull() & (F.col("best") >= 0))
    hosts = stage(known.groupBy("host", "domain").agg(*_votes(classes)), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(classes)])
    whole = _shares(rows, classes)
    own = _array(classes)
    smoothed = F.zip_with(own, F.array(*[F.lit(x) for x in whole]), lambda n, p: (n + STRENGTH * p) / (_sum(own) + STRENGTH))
    domains = stage(domains.select("domain", smoothed.alias("domain_prior")), "domains")
    return stage(look_up(hosts.select("host", "domain", _array(classes).alias("host_votes")), domains, "domain").drop("domain"), "priors")


def identify(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """Classify rows with columns text, declared, suffix, host, domain; other columns are kept.

    Adds lang, posterior, text_lang and accepted.
    """
    classes = len(languages) + 1
    kept = [c for c in rows.columns if c not in ("text", "declared", "suffix", "host", "domain")]
    scored = stage(text_likelihoods(rows, model), "likelihoods")
    out = look_up(scored, _value_likelihood(scored, "declared", classes), "declared")
    out = look_up(out, _value_likelihood(scored, "suffix", classes), "suffix")
    out = look_up(out, _host_votes(scored, classes), "host")

    whole = F.array(*[F.lit(x) for x in _shares(scored, classes)])
    prior = F.coalesce("domain_prior", whole)
    votes = F.coalesce("host_votes", F.array_repeat(F.lit(0.0), classes))
    others = F.transform(votes, lambda n, i: F.greatest(F.lit(0.0), n - F.when((i == F.col("best")) & F.col("host").isNotNull(), 1.0).otherwise(0.0)))
    out = out.withColumns({"_prior": prior, "_others": others})
    host = F.zip_with("_others", "_prior", lambda n, p: F.log((n + STRENGTH * p) / (_sum(F.col("_others")) + STRENGTH)))
    none = F.array_repeat(F.lit(0.0), classes)
    score = F.zip_with("ll", host, lambda a, b: a + b)
    for column in ("declared_l", "suffix_l"):
        score = F.zip_with(score, F.coalesce(column, none), lambda a, b: a + b)
    out = out.withColumn("_score", score).withColumn("_most", F.array_max("_score"))
    out = out.withColumn("_total", F.aggregate("_score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_most"))))
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    lang = F.element_at(names, F.array_position("_score", F.col("_most")).cast("int"))
    text_lang = F.when(F.col("best") >= 0, F.element_at(names, F.greatest(F.col("best"), F.lit(0)) + 1))
    out = out.withColumns({"lang": lang, "posterior": 1 / F.col("_total"), "text_lang": text_lang})
    accepted = (F.col("letters") > 0) & (F.col("lang") != UNKNOWN) & (F.col("posterior") >= ACCEPT)
    return out.select(*[c for c in kept if c != "lang"], "lang", "posterior", "text_lang", accepted.alias("accepted"))


def document_evidence(docs: DataFrame, *kept: str) -> DataFrame:
    """Documents: the language column is the declaration, the source is the host; they have no address."""
    declared = F.lower(F.split("lang", "[-_]")[0])
    nothing = F.lit(None).cast("string")
    return docs.select(*kept, "text", declared.alias("declared"), nothing.alias("suffix"), F.concat(F.lit("source "), "source").alias("host"), F.lit("sources").alias("domain"))


def page_evidence(pages: DataFrame, *kept: str) -> DataFrame:
    """Web pages: text without tags, scripts and styles; the ``lang`` attribute; host name and its last labels."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-zA-Z]+)""", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    known = host.isNotNull() & (host != "")
    domain = F.when(known, F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), "."))
    return pages.select(
        *kept,
        text.alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.when(known, F.element_at(labels, -1)).alias("suffix"),
        F.when(known, host).alias("host"),
        domain.alias("domain"),
    )


def label_rows(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.lower(F.split("lang", "[-_]")[0]).alias("label"))


def documents_and_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, lang, posterior, text_lang, accepted) for every document and every page."""
    languages, model = train(label_rows(docs))
    no_id = F.lit(None).cast("bigint")
    own = document_evidence(docs.withColumn("page_id", no_id), "doc_id", "page_id")
    web = page_evidence(pages.withColumn("doc_id", no_id), "doc_id", "page_id")
    return identify(own.unionByName(web), languages, model)
