"""Documents that hold benchmark passages, by latent semantic retrieval.

1. The words of the benchmark are the features.  Their document frequencies are counted
   over all passages (``PASSAGE`` words) of all documents, words the benchmark lacks weigh
   like its median word.
2. A distributed randomised SVD of the benchmark's TF-IDF rows gives the latent space: tasks
   add up ``A'(A W)`` for a random ``W``, an orthonormal basis of it is sent back, and the
   Gram matrix of the projected rows yields the singular directions.
3. Documents are read in overlapping windows of two sizes, of more where the block has longer
   items, so that the largest holds each of them, and in finer steps where it has items
   of fewer than ``SHORT`` words.  A window whose weight lies
   mostly on words that the benchmark lacks is passed over, as its cosine with any item is
   bounded by that share (with short items in the block, one that holds fewer known words than
   ``PARAPHRASE`` of the shortest); the others are compared with all items by latent cosine.
4. Candidates are decided on the words around the window: the longest common subsequence
   with a part of them little longer than the item must cover ``COPY`` of the item, or ``PARAPHRASE`` of it and ``ANSWER`` of its answer, the
   last quarter of its words.

Words are runs of letters and digits in lower case, so marks and spaces do not matter.
The benchmark is taken in blocks of at most ``ITEMS`` rows, the documents are read once per
block.  Its features are numbered up to ``SLOTS``; a larger vocabulary shares numbers.

Items that are null or have fewer than ``MIN_WORDS`` words match nothing, nor do null and
empty documents.  Equal items are reported each.  Repeated documents are reported each, as
often as they occur.  Columns other than ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseq.llm.common import numbered, text_bytes
from vigilseq.llm.words import text_parts, word_hashes
from vigilseq.sources.staging import stage

PASSAGE = 64
STEP = 16  # words between windows
SIZES = (2, 4)  # steps in a window
SHORT = 9  # words of an item that is lost in a window of 2 * STEP words
RANK = 128
EXTRA = 16  # columns of the random matrix beyond the rank
SLOTS = 1 << 16
ITEMS = 10_000
MIN_WORDS = 5
KNOWN_SHARE = 0.2  # of a window's squared weight, on words of the benchmark
COSINE = 0.45
COPY = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
COMPACT_STEP = 4

_PLAIN = bytes(
    c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else (ord(chr(c).lower()) if chr(c).isupper() else 32) for c in range(256)
)


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without marks, and where each text starts."""
    return word_hashes([t.translate(_PLAIN) for t in texts])


@dataclass(frozen=True)
class Features:
    """Sorted word hashes of the benchmark with their weights; ``other`` is the weight of all other words."""

    words: np.ndarray
    weights: np.ndarray
    other: float

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for words the benchmark lacks."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def _vocabulary(items: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(plain_words(text_bytes(batch.column(0)))[0])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["word"])

    table = items.select("text").mapInArrow(run, "word bigint").distinct().toArrow()  # words of the benchmark
    return np.sort(table.column(0).to_numpy().view(np.uint64))


def fit_weights(docs: DataFrame, vocabulary: np.ndarray) -> Features:
    """Inverse passage frequencies over all documents."""
    plain = Features(vocabulary, np.ones(len(vocabulary)), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, passages = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for _, _, texts in text_parts(batch.column(0)):
                hashes, offsets = plain_words(texts)
                place, own, count = _blocks(offsets, PASSAGE)
                at = plain.number(hashes)
                known = np.flatnonzero(at >= 0)
                pairs = np.unique(own[known] * len(counts) + at[known])
                counts += np.bincount(pairs % len(counts), minlength=len(counts))
                passages += count
        counts[-1] = passages
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["at", "n"])

    found = docs.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    weights = np.log((counts[-1] + 1) / (counts[:-1] + 0.5))
    weights = np.maximum(weights, 0.01)
    return Features(vocabulary, weights, float(np.median(weights)) if len(weights) else 1.0)


def _blocks(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block of each text, the block of each word, and the number of blocks."""
    lengths = np.diff(offsets)
    per_text = -(-lengths // size)
    first = np.cumsum(per_text) - per_text
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    return first, np.repeat(first, lengths) + inside // size, int(per_text.sum())


def _rows(texts: list[bytes], features: Features) -> np.ndarray:
    """TF-IDF rows of texts over the slots in use, of unit length."""
    hashes, offsets = plain_words(texts)
    at = features.number(hashes)
    out = np.zeros((len(texts), min(SLOTS, len(features.words))), np.float32)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    np.add.at(out, (row[at >= 0], at[at >= 0] % SLOTS), features.weights[at[at >= 0]])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _summed(items: DataFrame, part, height: int, width: int) -> np.ndarray:
    """Sum of ``part(texts)``, a (height, width) matrix, over all batches of items: 1024 rows a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for at in range(0, len(texts), 256):
                total += part(texts[at : at + 256])
        pieces = range(0, height, 1024)
        data = [total[p : p + 1024].astype(np.float64).tobytes() for p in pieces]
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array(data, pa.binary())], ["piece", "data"])

    def add(table: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(x, np.float64) for x in table.column("data").to_pylist())
        return pa.table({"piece": table.column("piece")[:1], "data": pa.array([data.tobytes()], pa.binary())})

    spec = "piece int, data binary"
    found = items.select("text").mapInArrow(run, spec).groupBy("piece").applyInArrow(add, spec).toArrow()
    out = np.zeros((height, width))
    for piece, data in zip(found.column("piece").to_pylist(), found.column("data").to_pylist()):
        out[piece : piece + 1024] += np.frombuffer(data, np.float64).reshape(-1, width)
    return out


def fit_space(items: DataFrame, features: Features, rank: int = RANK, extra: int = EXTRA, seed: int = 11) -> np.ndarray:
    """(slots, rank): right singular directions of the benchmark's TF-IDF rows, by a randomised range finder."""
    height = min(SLOTS, len(features.words))
    width = min(height, rank + extra)
    if not width:
        return np.zeros((0, 0), np.float32)

    def ranged(texts: list[bytes]) -> np.ndarray:
        rows = _rows(texts, features)
        random = np.random.default_rng(seed).normal(size=(height, width)).astype(np.float32)
        return rows.T @ (rows @ random)

    basis = np.linalg.qr(_summed(items, ranged, height, width))[0].astype(np.float32)

    def gram(texts: list[bytes]) -> np.ndarray:
        low = _rows(texts, features) @ basis
        return low.T @ low

    values, directions = np.linalg.eigh(_summed(items, gram, width, width))
    best = np.argsort(-values)[:rank]
    return (basis @ directions[:, best]).astype(np.float32)


def common_subsequence(item: list[int], span: list[int]) -> int:
    """Length of the longest common subsequence, one bit per word of the item."""
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    free = full = (1 << len(item)) - 1
    for word in span:
        match = free & places.get(word, 0)
        if match:
            free = ((free + match) | (free - match)) & full
    return len(item) - free.bit_count()


def answer_of(item: list[int]) -> list[int]:
    return item[-max(3, len(item) // 4) :]


def overlap(item: list[int], span: list[int]) -> tuple[float, float]:
    """Best shares of the item, and of its answer, that one compact part of the span holds in order.

    A part is a quarter longer than the item, so that words scattered over a long span
    do not add up to it.
    """
    share = common_subsequence(item, span) / len(item)
    size = len(item) + len(item) // 4 + COMPACT_STEP
    if share < PARAPHRASE or len(span) <= size:
        return share, common_subsequence(answer_of(item), span) / len(answer_of(item))
    best = (0.0, 0.0)
    for at in range(0, len(span) - size + COMPACT_STEP, COMPACT_STEP):
        part = span[at : at + size]
        share = common_subsequence(item, part) / len(item)
        best = max(best, (share, common_subsequence(answer_of(item), part) / len(answer_of(item))))
    return best


def is_leak(share: float, answer: float) -> bool:
    return share >= COPY or (share >= PARAPHRASE and answer >= ANSWER)


@dataclass(frozen=True)
class Block:
    """Some items: ids, words, and latent unit vectors."""

    ids: list
    words: list[list[int]]
    vectors: np.ndarray

    def windows(self) -> tuple[int, tuple[int, ...]]:
        """Words between windows and steps in a window, from the lengths of the items."""
        lengths = [len(w) for w in self.words] or [SHORT]
        step, sizes = (STEP, SIZES) if min(lengths) >= SHORT else (STEP // 2, (SIZES[0], *(2 * s for s in SIZES)))
        while sizes[-1] * step < max(lengths):
            sizes = (*sizes, 2 * sizes[-1])
        return step, sizes

    def least(self) -> int:
        """Known words a window must hold to be compared, where the block has short items; else 0."""
        shortest = min(map(len, self.words), default=SHORT)
        return math.ceil(PARAPHRASE * shortest) if shortest < SHORT else 0

    def slack(self, item: int, words: int) -> int:
        """Words to add on each side of a window; a long item and its insertions fit in wherever the window meets it."""
        n = len(self.words[item])
        return STEP if n <= SIZES[-1] * STEP else max(STEP, n + n // 4 + COMPACT_STEP + STEP - words)


def _block(table: pa.Table, features: Features, space: np.ndarray) -> Block:
    texts, ids = text_bytes(table.column("text")), table.column("item_id").to_pylist()
    hashes, offsets = plain_words(texts)
    words = [hashes[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    kept = [i for i, w in enumerate(words) if len(w) >= MIN_WORDS]
    vectors = np.concatenate([_rows([texts[i]], features) @ space for i in kept] or [np.zeros((0, space.shape[1]), np.float32)])
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Block([ids[i] for i in kept], [words[i] for i in kept], vectors.astype(np.float32))


def window_candidates(
    hashes: np.ndarray, offsets: np.ndarray, features: Features, space: np.ndarray, items: np.ndarray, step: int = STEP, sizes: tuple = SIZES, least: int = 0
):
    """(text, first word, end word, item, cosine) of windows near an item, from the words of some texts."""
    at = features.number(hashes)
    known = np.flatnonzero(at >= 0)
    first, own, count = _blocks(offsets, step)
    weights = np.where(at >= 0, features.weights[np.maximum(at, 0)] if len(features.weights) else 0.0, features.other)
    whole = np.bincount(own, weights**2, minlength=count)
    mine = np.bincount(own[known], weights[known] ** 2, minlength=count)
    text = np.repeat(np.arange(len(first)), -(-np.diff(offsets) // step))
    last = np.append(first[1:], count)[text]  # first block after the text

    def sums(values: np.ndarray, size: int) -> np.ndarray:
        total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
        return total[np.minimum(np.arange(count) + size, last)] - total[:count]

    if least:  # short items weigh too little in a window for its share
        holds = np.bincount(own[known], minlength=count)
        near = [np.flatnonzero(sums(holds, size) >= least) for size in sizes]
    else:
        near = [np.flatnonzero(sums(mine, size) >= KNOWN_SHARE * sums(whole, size)) for size in sizes]
    wanted = np.zeros(count + max(sizes), bool)
    for size, start in zip(sizes, near):
        for ahead in range(size):
            wanted[start + ahead] = True
    wanted = wanted[:count]
    if not wanted.any() or not len(items):
        return
    # Words of the wanted blocks side by side; the last row of the weighted space is zero.
    weighted = np.concatenate((space[np.arange(len(features.words)) % SLOTS] * features.weights[:, None], np.zeros((1, space.shape[1]))))
    weighted = weighted.astype(np.float32)
    kept = np.flatnonzero(wanted)
    compact = np.cumsum(wanted) - 1
    some = known[wanted[own[known]]]
    beside = np.full((len(kept), step), len(weighted) - 1)
    beside[compact[own[some]], (some - np.repeat(offsets[:-1], np.diff(offsets))[some]) % step] = at[some]
    near_vectors = np.zeros((len(kept), space.shape[1]), np.float32)
    for low in range(0, len(kept), 1_024):
        for place in range(step):
            near_vectors[low : low + 1_024] += weighted[beside[low : low + 1_024, place]]
    vectors = np.zeros((count, space.shape[1]), np.float32)
    vectors[kept] = near_vectors
    padded = np.concatenate((vectors, np.zeros((max(sizes), space.shape[1]), np.float32)))
    for size, start in zip(sizes, near):
        for low in range(0, len(start), 8_192):
            begin = start[low : low + 8_192]
            window = sum(padded[begin + ahead] * (begin + ahead < last[begin])[:, None] for ahead in range(size))
            window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
            cosine = window @ items.T
            row, item = np.nonzero(cosine >= COSINE)
            place = begin[row]
            from_word = offsets[text[place]] + (place - first[text[place]]) * step
            end_word = np.minimum(from_word + size * step, offsets[text[place] + 1])
            yield text[place], from_word, end_word, item, cosine[row, item]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_share) for every document and item that it holds."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(F.col(text_col)).alias("text"))
    items = numbered(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.lower("text").alias("text")))
    features = fit_weights(rows, _vocabulary(items))
    space = fit_space(items, features)
    cut = stage(items.withColumn("block", F.floor(F.col("_row") / ITEMS)), "items")
    found = None
    for (number,) in cut.select("block").distinct().orderBy("block").collect():  # items / ITEMS rows
        block = _block(cut.filter(F.col("block") == number).select("item_id", "text").toArrow(), features, space)
        leaks = _search(rows, features, space, block)
        found = leaks if found is None else found.unionByName(leaks)
    if found is None:
        return rows.limit(0).selectExpr("id", "id item_id", "0d cosine", "0d lcs_share", "0d answer_share")
    return found


def _search(rows: DataFrame, features: Features, space: np.ndarray, block: Block) -> DataFrame:
    names = ["id", "item_id", "cosine", "lcs_share", "answer_share"]
    step, sizes = block.windows()

    def leaks(texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        hashes, offsets = plain_words(texts)
        best: dict[tuple[int, int], tuple] = {}
        for parts in window_candidates(hashes, offsets, features, space, block.vectors, step, sizes, block.least()):
            order = np.argsort(-parts[4], kind="stable")
            for text, begin, end, item, cosine in zip(*(p[order].tolist() for p in parts)):
                if (text, item) in best:
                    continue
                slack = block.slack(item, end - begin)
                low, high = max(offsets[text], begin - slack), min(offsets[text + 1], end + slack)
                share, answer = overlap(block.words[item], hashes[low:high].tolist())
                if is_leak(share, answer):
                    best[text, item] = (text, item, cosine, share, answer)
        return list(best.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, _, texts in text_parts(batch.column(1)):
                found = leaks(texts)
                if found:
                    text, item, cosine, share, answer = zip(*found)
                    columns = [
                        ids.take(pa.array([low + t for t in text])),
                        pa.array([block.ids[i] for i in item], pa.int64()),
                        *[pa.array(x, pa.float64()) for x in (cosine, share, answer)],
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "id bigint, item_id bigint, cosine double, lcs_share double, answer_share double")
