"""Periodic runs of words, found by recompression.

A run is a stretch of words with smallest period q and at least ``max(MIN_WORDS,
MIN_TIMES * q)`` words that no neighbouring word extends.

The words of some documents, each document closed by a symbol of its own, are compressed
in levels that alternate: blocks of a repeated symbol become one symbol, then pairs with
the left symbol in one half of the alphabet and the right one in the other become one.
Equal symbols of a level stand for equal words, so the levels are a run-length grammar.
An extension query climbs from two words to the longest equal symbols that start (or end)
there and comes down where they differ; a block is passed in one step.  The top of the
grammar is the level on which no symbol occurs twice.

Candidates are the pairs (i, i + p) of equal words with i on a grid whose step grows with
p, a harmonic number of them.  The grid meets every run at its own period, and the exact
extensions of a candidate to both sides give the run.

Grammars are built over ``words.SLICE_BYTES`` of text or one document, and candidates are
checked ``CANDIDATES`` at a time.  Nothing is shuffled: a document is read by one task.

Words are parted by white space.  Null and empty texts have no words, no runs and an empty
collapsed text.  Every row gives one row, repeated ones too; other columns are kept, but a
column named as one of the result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.llm.common import mix64, unused
from vigilseq.llm.words import text_parts

MIN_WORDS = 24
MIN_TIMES = 3
CANDIDATES = 1 << 18
HALVINGS = 16  # halves of an alphabet that are tried
PIECE = 1 << 16  # bytes of a text parted into words at once
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "struct<start:bigint,length:bigint,period:bigint>"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Side:
    """How symbols of the grammar are reached from one end: flat arrays over all levels."""

    up: np.ndarray  # symbol above that has this one at its end, or -1
    down: np.ndarray  # symbol below at the end, -1 for words
    repeat: np.ndarray  # equal symbols from here on
    edge: np.ndarray  # word where the symbol begins (ends, on the other side)


@dataclass(frozen=True)
class Grammar:
    symbols: np.ndarray
    ahead: Side
    back: Side


def _blocks(symbols: np.ndarray) -> np.ndarray:
    """First places of the blocks of a repeated symbol."""
    return np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))


def _pairs(symbols: np.ndarray, level: int) -> np.ndarray:
    """First places of the pairs and of the symbols left alone; neighbours differ.

    The halves of the alphabet are a bit of the symbols' hash, the next one if it joins few.
    """
    mixed, best, most = mix64(symbols.astype(np.uint64) + np.uint64(level << 40)), None, -1
    for bit in range(HALVINGS):
        side = (mixed >> np.uint64(bit) & np.uint64(1)).astype(bool)
        for joined in (~side[:-1] & side[1:], side[:-1] & ~side[1:]):
            if (n := int(joined.sum())) > most:
                best, most = joined, n
        if 8 * most >= len(symbols):
            break
    return np.flatnonzero(np.concatenate(([True], ~best)))


def build_grammar(words: np.ndarray) -> Grammar:
    """Levels of block and pair compression over word numbers."""
    symbols = [words.astype(np.int64)]
    first = [np.arange(len(words) + 1)]  # word where each symbol begins, and the end
    heads: list[np.ndarray] = []  # places in the level below
    while True:
        top, level = symbols[-1], len(heads)
        at = _pairs(top, level) if level % 2 else _blocks(top)
        ends = np.append(at, len(top))
        size = np.diff(ends)
        if level % 2:
            second = np.where(size == 2, top[np.minimum(at + 1, len(top) - 1)] + 1, 0)
        else:
            second = size
        # A pair is named by both symbols, a block by its symbol and length, a symbol alone by itself.
        named = np.unique(top[at] * (max(int(second.max()), 1) + 1) + second, return_inverse=True)[1]
        heads.append(ends)
        symbols.append(named.astype(np.int64))
        first.append(first[-1][ends])
        if level % 2 and (int(named.max()) + 1 == len(named) or len(at) == len(top) == len(symbols[-3])):
            break
    starts = np.concatenate(([0], np.cumsum([len(s) for s in symbols])))
    total = int(starts[-1])
    sides = {name: Side(*(np.full(total, -1, np.int64) for _ in range(2)), np.ones(total, np.int64), np.empty(total, np.int64)) for name in ("ahead", "back")}
    ahead, back = sides["ahead"], sides["back"]
    for k, own in enumerate(symbols):
        here = slice(int(starts[k]), int(starts[k + 1]))
        ahead.edge[here], back.edge[here] = first[k][:-1], first[k][1:]
        if k < len(heads):
            above = np.arange(len(symbols[k + 1])) + starts[k + 1]
            head, tail = heads[k][:-1], heads[k][1:] - 1
            ahead.up[starts[k] + head], back.up[starts[k] + tail] = above, above
            ahead.down[above], back.down[above] = starts[k] + head, starts[k] + tail
            if k % 2 == 0:
                place, size = np.arange(len(own)), np.diff(heads[k])
                ahead.repeat[here] = np.repeat(heads[k][1:], size) - place
                back.repeat[here] = place - np.repeat(head, size) + 1
    return Grammar(np.concatenate(symbols), ahead, back)


def extend(grammar: Grammar, left: np.ndarray, right: np.ndarray, ahead: bool = True) -> np.ndarray:
    """Words that agree from the places ``left`` and ``right`` on (``ahead``), or up to them."""
    side, step = (grammar.ahead, 1) if ahead else (grammar.back, -1)
    x, y = left.copy(), right.copy()
    start = side.edge[left]
    found = np.zeros(len(x), np.int64)
    active = np.arange(len(x))
    climbing = np.ones(len(x), bool)
    while len(active):
        a, b = x[active], y[active]
        same = grammar.symbols[a] == grammar.symbols[b]
        above, beside = side.up[a], side.up[b]
        climb = same & climbing[active] & (above >= 0) & (beside >= 0)
        skip = same & ~climb
        hop = step * np.minimum(side.repeat[a], side.repeat[b])
        down = side.down[a]
        differ = ~same
        climbing[active[differ]] = False
        x[active] = np.where(climb, above, np.where(skip, a + hop, down))
        y[active] = np.where(climb, beside, np.where(skip, b + hop, side.down[b]))
        ended = differ & (down < 0)
        over = active[ended]
        found[over] = np.abs(side.edge[a[ended]] - start[over])
        active = active[~ended]
    return found


def _grid(last: int, sizes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the candidates, ``CANDIDATES`` or so at a time.

    ``sizes`` are the words of the documents, largest first, ``ends`` where they end; a
    period is tried in the documents that hold it ``MIN_TIMES`` times.
    """
    p = np.arange(1, last + 1)
    held = np.searchsorted(-sizes, -np.maximum(MIN_TIMES * p, MIN_WORDS), side="right")
    reach = np.where(held > 0, ends[np.maximum(held, 1) - 1], 0)
    step = np.maximum((MIN_TIMES - 1) * p, MIN_WORDS - p)
    count = np.maximum(-(-(reach - p) // step), 0)
    total = np.cumsum(count)
    at = 0
    while at < last:
        done = total[at - 1] if at else 0
        # A period with more candidates than that comes alone; there are no more of them than words.
        upto = max(at + 1, int(np.searchsorted(total, done + CANDIDATES, side="right")))
        own = count[at:upto]
        periods = np.repeat(p[at:upto], own)
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        yield inside * np.repeat(step[at:upto], own), periods
        at = upto


def find_runs(documents: list[np.ndarray]) -> list[np.ndarray]:
    """(start, length, period) of the runs of each document, by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    none = np.zeros((0, 3), np.int64)
    found = [none] * len(documents)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= MIN_WORDS]
    if not len(order):
        return found
    closing = 1 + max(int(documents[i].max()) for i in order)  # numbers that are no words
    parts = [np.array([closing])]
    for n, i in enumerate(order, 1):
        parts += [documents[i], np.array([closing + n])]
    words = np.concatenate(parts)
    ends = 1 + np.cumsum(sizes[order] + 1)
    owner = np.zeros(len(words), np.int64)
    owner[1:] = np.repeat(np.arange(len(order)), sizes[order] + 1)
    grammar = None
    segments = []
    for place, period in _grid(int(sizes[order[0]]) // MIN_TIMES, sizes[order], ends):
        place = place + 1
        fits = place + period < len(words)
        place, period = place[fits], period[fits]
        alike = (words[place] == words[place + period]) & (owner[place] == owner[place + period])
        place, period = place[alike], period[alike]
        if not len(place):
            continue
        grammar = grammar or build_grammar(words)
        ahead = extend(grammar, place, place + period)
        back = extend(grammar, place - 1, place + period - 1, ahead=False)
        length = period + ahead + back
        kept = length >= np.maximum(MIN_WORDS, MIN_TIMES * period)
        if kept.any():
            segments.append(np.unique(np.stack([(place - back)[kept], length[kept], period[kept]], axis=1), axis=0))
    if not segments:
        return found
    # A stretch found at multiples of its period is kept at the smallest.
    runs = np.unique(np.concatenate(segments), axis=0)
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = owner[runs[:, 0]]
    bounds = np.searchsorted(of, np.arange(len(order) + 1))
    begins = ends - sizes[order] - 1
    for n, i in enumerate(order):
        if bounds[n] < bounds[n + 1]:
            found[i] = runs[bounds[n] : bounds[n + 1]] - np.array([begins[n], 0, 0])
    return found


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def number_words(text: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """Number of each word; new ones are added to ``numbers``."""
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def best_run(runs: np.ndarray) -> dict[str, int] | None:
    """The run with the greatest length / period; ties go to the smallest start, then period."""
    if not len(runs):
        return None
    start, length, period = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return {"start": start, "length": length, "period": period}


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words``, ``runs``, ``best`` (null without runs) and ``collapsed`` text."""
    added = ["n_words", "runs", "best", "collapsed"]
    others = [c for c in docs.columns if c != text_col and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_parts(batch.column(0)):
                numbers: dict[bytes, int] = {}
                documents = [number_words(t, numbers) for t in texts]
                names = list(numbers)
                runs = find_runs(documents)
                collapsed = [
                    b" ".join(map(names.__getitem__, (d[kept_words(len(d), r)] if len(r) else d).tolist())) for d, r in zip(documents, runs)
                ]
                ends = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
                flat = np.concatenate(runs)
                fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(RUN))
                columns = [batch.column(i + 1).slice(low, high - low) for i in range(len(others))]
                columns += [
                    pa.array([len(d) for d in documents], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields),
                    pa.array([best_run(r) for r in runs], RUN),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *added])

    rows = docs.select(F.col(text_col).alias(unused("text", others)), *[docs[f"`{c}`"] for c in others])
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kept + ', ' if kept else ''}n_words bigint, runs array<{RUN_DDL}>, best {RUN_DDL}, collapsed string")


def repeated_by_id(docs: DataFrame) -> Column:
    """Texts in which every tenth document, by the hash of its id, goes round a stretch of its own words.

    With h the hash and n the words, the words from a = g % n on, g = floor(h / 10), repeat
    with period 1 + floor((n - a) / (3 + g % 8)).  Documents without id keep their text.
    """
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    parted = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def turned(one: Column) -> Column:
        n, g = F.size(one["words"]), one["g"]
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = F.sequence(F.lit(0), n - 1)
        return F.array_join(F.transform(place, lambda i: F.get(one["words"], F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")

    # The words are bound by a lambda, so that they are parted once and not for every word.
    bound = F.array(F.struct(parted.alias("words"), F.floor(h / 10).alias("g")))
    looped = F.transform(F.filter(bound, lambda one: F.size(one["words"]) > 0), turned)
    return F.when(h % 10 == 0, F.coalesce(F.get(looped, F.lit(0)), docs["text"])).otherwise(docs["text"])


def document_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) per document."""
    found = collapse_runs(docs.select("doc_id", repeated_by_id(docs).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
