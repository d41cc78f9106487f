"""Alignment of the tokens of two tokenizers, and how usual each linked pair of ids is.

Both tokenizers encode a space and the text.  The tokens of a batch lie in two pandas
frames by byte offset; ``merge_asof``, keyed by document, gives each token start the
token of the other side that covers it.  Both directions together are the overlaps, and
overlaps with equal ends close the groups: shortest stretches that both sides cut alike.
All tokens of one side of a group are linked with all of the other.

Texts are cut at single spaces between two visible characters.  There the byte-level
pattern starts a new word, and no piece of the other vocabulary goes on over a space (this
is checked when it is loaded; otherwise texts are encoded whole), so the parts are encoded
alone with the same result, each distinct one once per batch of ``SLICE_BYTES``.  A
longer text is aligned that much at a time.

A document's distinct pairs are stored with their times.  Documents per pair are a count
with a map-side sum.  To bring counts back, the pairs of most documents, at most
``FREQUENT`` rows, are sent to the executors and looked up in place; only pairs in fewer
documents are shuffled to their counts.  The highest count of an id of the first
vocabulary is one row per id.

Null and empty texts have no tokens, nor do texts that the tokens do not give back byte for
byte: zeros and an empty ``groups``.  Every row is a document, repeated ones too.  Other
columns are kept, but a column named as one of the result gives way to it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilseq.llm.common import unused
from vigilseq.llm.token_counts import FOLDER, PATTERN, load_vocabulary
from vigilseq.llm.words import text_parts
from vigilseq.sources.staging import stage

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
SPACE = "▁"  # stands for a space in a piece
SLICE_BYTES = 1 << 20  # text aligned at once, or one document
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
JOINED = 256  # parts encoded as one text
LINKS = 1 << 21  # links spelled out at once
FREQUENT = 1 << 18  # pairs sent to every executor
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_letters() -> dict[str, int]:
    """Letters of byte-level entries: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_encoder(file: bytes):
    """Function from texts to lists of ids by a byte-level vocabulary file, and the bytes of its entries.

    A plain file, whose merges are numbered in their order and whose texts are cut by the
    usual pattern, is encoded by its ranks, which gives the same ids in less time.
    """
    content, letters = json.loads(file), _byte_letters()
    model, cut = content["model"], content["pre_tokenizer"] or {}
    ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    names = {i: token for token, i in ids.items()}
    entries = [names.get(i, b"") for i in range(max(names) + 1)]
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = not content["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if plain and merged == sorted(merged) and len(merged) + 256 == len(ids):
        ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        return lambda texts: [ranks.encode_ordinary(t) for t in texts], entries
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_str(file.decode())
    whole.encode_special_tokens = True
    return lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)], entries


class Tokenizers:
    """Both tokenizers of a task, the bytes of their entries and the spellings of their ids."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        self.a, self.a_bytes = byte_level_encoder(byte_level)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.local = not any(SPACE in p.lstrip(SPACE) for p in names)
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # Ids followed by what may follow them: A "," "|", B "," ";" and the end.
        self.spelling = np.array(
            [f"{i}{after}" for n, ends in ((len(self.a_bytes), ",|"), (len(names), (",", ";", ""))) for after in ends for i in range(n)], object
        )
    def parts(self, text: str) -> list[str]:
        return CUT.split(text) if self.local else [text]

    def chunks(self, text: str) -> Iterator[str]:
        """The text in parts of about ``SLICE_BYTES``, cut as above."""
        at = 0
        while True:
            cut = CUT.search(text, at + SLICE_BYTES // 2) if self.local and len(text) - at > SLICE_BYTES else None
            yield text[at : cut.start() if cut else len(text)]
            if not cut:
                return
            at = cut.end()

    def ids(self, parts: Sequence[str], size: np.ndarray, inner: Sequence[bool]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of distinct parts one after the other, and how many each part has.

        ``size`` is a part's length in bytes with the space before it.  ``inner`` parts begin and end at a visible character.  The byte-level tokenizer takes
        ``JOINED`` of them as one text, whose tokens end where the parts end.
        """
        inside, alone = np.flatnonzero(inner), np.flatnonzero(~np.array(inner, bool))
        own = [parts[i] for i in inside]
        joined = [" " + " ".join(own[i : i + JOINED]) for i in range(0, len(own), JOINED)]
        some = _flat(self.a(joined))
        ends = np.searchsorted(np.cumsum(self.a_size[some[0]]), np.cumsum(size[inside])) + 1
        rest = _flat(self.a([" " + parts[i] for i in alone]))
        count = np.zeros(len(parts), np.int64)
        count[inside], count[alone] = np.diff(ends, prepend=0), rest[1]
        first = np.cumsum(count) - count
        a = np.empty(count.sum(), np.int64)
        for ids, places in ((some[0], inside), (rest[0], alone)):
            a[_spread(first[places], count[places])] = ids
        b = self.b.encode(list(parts), num_threads=1)
        return [(a, count), _flat(b)]


def _flat(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of stretches that begin at ``first`` and hold ``count``, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


@dataclass
class Tokens:
    """Tokens of one side of some texts, text by text."""

    ids: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"text": self.text, "start": self.start, "token": np.arange(len(self.ids))})


@dataclass
class Aligned:
    """What one document, or a part of it, adds up to."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros(len(COUNTS), np.int64))
    groups: list[str] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def add(self, other: Aligned) -> None:
        self.counts = self.counts + other.counts
        self.groups += other.groups
        self.pairs, self.times = _summed(np.concatenate((self.pairs, other.pairs)), np.concatenate((self.times, other.times)))


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, times, len(keys)).astype(np.int64)


def encode(texts: Sequence[str], tools: Tokenizers) -> tuple[Tokens, Tokens, np.ndarray]:
    """Tokens of both sides, and which texts their bytes give back.  Other texts and empty ones have none."""
    parts = [tools.parts(t) if t else [] for t in texts]
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    names = list(dict.fromkeys(chain.from_iterable(parts)))
    numbers = dict(zip(names, range(len(names))))
    which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
    of = np.repeat(np.arange(len(texts)), count)
    outer = {p for own in parts for p in (own[:1] + own[-1:])}
    size = np.fromiter(map(len, map(str.encode, names)), np.int64, len(names)) + 1  # with the space
    known = tools.ids(names, size, [p not in outer for p in names])
    whole = "".join([" " + p for p in names]).encode()
    starts = np.cumsum(size) - size
    kept = np.ones(len(texts), bool)
    sides = []
    for (flat, count), spelled, sizes in zip(known, (tools.a_bytes, tools.b_bytes), (tools.a_size, tools.b_size)):
        first, times = np.cumsum(count) - count, count[which]
        ids, text = flat[_spread(first[which], times)], np.repeat(of, times)
        back = b"".join(map(spelled.__getitem__, flat.tolist()))
        bounds = np.concatenate(([0], np.cumsum(sizes[flat])))[np.append(first, len(flat))]
        if back != whole or not np.array_equal(np.diff(bounds), size):
            # A part that comes back changed spoils its texts, unless the whole comes back all the same.
            good = np.array([back[x:y] == whole[a : a + n] for x, y, a, n in zip(bounds, bounds[1:], starts, size)], bool)
            for t in np.unique(of[~good[which]]).tolist():
                kept[t] &= b"".join(map(spelled.__getitem__, ids[text == t].tolist())) == b" " + texts[t].encode()
        sides.append((ids, text, sizes[ids]))
    tokens = []
    for ids, text, size in sides:
        if not kept.all():
            own = kept[text]
            ids, text, size = ids[own], text[own], size[own]
        end = np.cumsum(size)  # offsets over all texts, so that they rise
        tokens.append(Tokens(ids, text, end - size, end))
    return tokens[0], tokens[1], kept


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (a, b) of all overlaps: the tokens that cover each other's starts."""
    left, right = a.frame(), b.frame()
    of_a = pd.merge_asof(left, right, on="start", by="text", suffixes=("_a", "_b"))
    of_b = pd.merge_asof(right, left, on="start", by="text", suffixes=("_b", "_a"))
    later = of_b["start"].to_numpy() != a.start[of_b["token_a"].to_numpy()]  # equal starts are among the first
    return (np.concatenate([x[f"token_{side}"].to_numpy() for x in (of_a, of_b[later])]) for side in "ab")


def _links(a: Tokens, b: Tokens, first_a: np.ndarray, first_b: np.ndarray, text: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the links of all groups, ``LINKS`` or one group at a time."""
    n_a, n_b, every = np.diff(first_a), np.diff(first_b), height * width
    total = np.cumsum(n_a * n_b)
    found = []
    at = 0
    while at < len(n_a):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, side="right")))
        if upto == at + 1 and n_a[at] * n_b[at] > LINKS:
            ids, counts = np.unique(a.ids[first_a[at] : first_a[upto]], return_counts=True)
            others, more = np.unique(b.ids[first_b[at] : first_b[upto]], return_counts=True)
            pair, times = (ids[:, None] * width + others).ravel(), (counts[:, None] * more).ravel()
            found.append((np.full(len(pair), text[at]), pair, times))
        else:
            one = np.arange(first_a[at], first_a[upto])
            group = np.repeat(np.arange(at, upto), n_a[at:upto])
            reps = n_b[group]
            pair = np.repeat(a.ids[one], reps) * width + b.ids[_spread(first_b[group], reps)]
            keys = np.sort(np.repeat(text[group] * every, reps) + pair)
            new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            found.append((keys[new] // every, keys[new] % every, np.diff(np.append(new, len(keys)))))
        at = upto
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def align(texts: Sequence[str], tools: Tokenizers) -> list[Aligned | None]:
    """Counts, groups and linked pairs of each text; None where the tokens do not give the text back."""
    a, b, kept = encode(texts, tools)
    found = [Aligned() if good else None for good in kept]
    if not len(a.ids):
        return found
    over_a, over_b = overlaps(a, b)
    closing = a.end[over_a] == b.end[over_b]
    firsts, groups = [], []
    for tokens, closed in ((a, over_a[closing]), (b, over_b[closing])):
        last = np.zeros(len(tokens.ids), bool)
        last[closed] = True
        ends = np.flatnonzero(last) + 1
        firsts.append(np.concatenate(([0], ends)))
        groups.append((np.cumsum(last) - last, last))
    (first_a, first_b), ((group_a, last_a), (group_b, last_b)) = firsts, groups
    text = a.text[first_a[:-1]]  # of each group

    codes = np.empty(len(a.ids) + len(b.ids), np.int64)
    ends_text = np.append(text[1:] != text[:-1], True)
    codes[np.arange(len(a.ids)) + first_b[group_a]] = a.ids + last_a * len(tools.a_bytes)
    after = np.where(last_b, 1 + ends_text[group_b], 0)
    codes[np.arange(len(b.ids)) + first_a[group_b + 1]] = 2 * len(tools.a_bytes) + b.ids + after * len(tools.b_bytes)
    spelled = tools.spelling[codes]

    owner, pair, times = _links(a, b, first_a, first_b, text, len(tools.a_bytes), len(tools.b_bytes))
    n = len(texts)
    per_text = [np.bincount(a.text, minlength=n), np.bincount(b.text, minlength=n), np.bincount(text, minlength=n)]
    links = np.bincount(text, np.diff(first_a) * np.diff(first_b), n).astype(np.int64)
    counts = np.stack([*per_text, links], axis=1)
    bounds = np.concatenate(([0], np.cumsum(counts[:, 0] + counts[:, 1])))
    mine = np.searchsorted(owner, np.arange(n + 1))
    for i in np.flatnonzero(counts[:, 2]).tolist():
        own = slice(int(mine[i]), int(mine[i + 1]))
        keys, sums = pair[own], times[own]
        if len(keys) > 1 and not (keys[1:] > keys[:-1]).all():  # a text over several steps
            keys, sums = _summed(keys, sums)
        found[i] = Aligned(counts[i], ["".join(spelled[bounds[i] : bounds[i + 1]].tolist())], keys, sums)
    return found


def align_document(text: str, tools: Tokenizers) -> Aligned:
    """A long text, a part at a time."""
    whole = Aligned()
    for chunk in tools.chunks(text):
        (part,) = align([chunk], tools)
        if part is None:
            return Aligned()
        whole.add(part)
    return whole


def align_documents(docs: DataFrame, text_col: str = "text", folder: str = FOLDER, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``docs`` without the text, with ``COUNTS``, ``groups`` (``a1,a2|b1;a3|b2``), and distinct linked ``pairs`` with ``times``.

    A pair is the id of the first side times the size of the second vocabulary, plus the
    id of the second side.
    """
    files = load_vocabulary(folder, byte_level), load_vocabulary(folder, pieces)
    added = [*COUNTS, "groups", "pairs", "times"]
    others = [c for c in docs.columns if c != text_col and c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = None
        for batch in batches:
            tools = tools or Tokenizers(*files)
            for low, high, texts in text_parts(batch.column(0), SLICE_BYTES):
                decoded = [t.decode("utf-8", "replace") for t in texts]
                if len(decoded) == 1 and len(texts[0]) > SLICE_BYTES:
                    found = [align_document(decoded[0], tools)]
                else:
                    found = [x or Aligned() for x in align(decoded, tools)]
                columns = [batch.column(i + 1).slice(low, high - low) for i in range(len(others))]
                columns += [pa.array(x) for x in np.stack([x.counts for x in found]).T]
                ends = pa.array(np.cumsum([0, *(len(x.pairs) for x in found)]), pa.int32())
                columns += [pa.array([";".join(x.groups) for x in found], pa.string())]
                columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([getattr(x, name) for x in found]))) for name in ("pairs", "times")]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *added])

    rows = docs.select(F.col(text_col).alias(unused("text", others)), *[docs[f"`{c}`"] for c in others])
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    sums = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(run, f"{kept}{sums}, groups string, pairs array<bigint>, times array<bigint>")


def _frequent(counts: DataFrame, most: int) -> int:
    """Least number of documents, a power of two, that at most ``most`` pairs reach."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.count(F.lit(1)).alias("pairs"))
    seen, least = 0, None
    for digits, pairs in sorted(map(tuple, sizes.collect()), reverse=True):  # at most 64 rows
        if seen + pairs > most:
            break
        seen, least = seen + pairs, 1 << digits - 1
    return least or 1 << 62


def link_statistics(found: DataFrame, row: str, width: int, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_best, count_sum) of written documents with ``pairs`` and ``times``; those without links are missing.

    ``width`` is the size of the second vocabulary.
    """
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.withColumn("a", F.expr(f"pair div {width}")), "pairs")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # at most one row per id
    ranked = counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    least = _frequent(counts, frequent)
    usual, rare = ranked.filter(F.col("n") >= least), ranked.filter(F.col("n") < least)
    each = found.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(row, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))

    def summed(links: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
        return links.groupBy(row).agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    in_place = summed(each.join(F.broadcast(usual), "pair"))
    apart = each.join(F.broadcast(usual.select("pair")), "pair", "left_anti")
    both = in_place.unionByName(summed(apart.join(rare, "pair")))
    return both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def hashed_groups() -> Column:
    return F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")


def document_alignment(docs: DataFrame, folder: str = FOLDER, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    width = sentencepiece.SentencePieceProcessor(model_proto=load_vocabulary(folder, PIECES)).get_piece_size()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    aligned = align_documents(rows, folder=folder).withColumn("groups_sha256", hashed_groups()).drop("groups")
    found = stage(aligned, "aligned")
    sums = link_statistics(found, "_row", width, frequent)
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")]
    return found.drop("pairs", "times").join(sums, "_row", "left").select("doc_id", *COUNTS, *zero, "groups_sha256")
