"""Near-duplicates by 64-bit SimHash with bit-sliced comparison.

Fingerprints are reduced to distinct ones.  Two that differ in at most four bits
agree on at least two of six blocks of bits, so each of the 15 pairs of blocks
is a bucket key, and all links lie inside buckets.  Within the buckets of a task
the bits are stored as vertical planes: one word holds the same bit of 64 rows.
Rows are compared with the row ``shift`` places on, 64 pairs a word; a
carry-save counter of three planes adds up the differing bits, and words whose
64 pairs all exceed the radius are abandoned.  Large buckets are compared block
by block in the same way, many shifts at once.  A task reports a spanning forest
of the links it finds, never the pairs.

Null texts count as empty.  Texts without words have fingerprint zero and link
like any other.  Rows without id get a fingerprint and a component, but an id
of null never names one.  Repeated ids and repeated rows give one row each.
Input columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilseq.llm.common import local_roots, sorted_groups
from vigilseq.llm.components import components
from vigilseq.llm.words import text_parts
from vigilseq.sources.staging import stage

SEED = 42
RADIUS = 4  # the blocks below hold for this radius
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, bits
BUCKET_ROWS = 1024  # a larger bucket is compared in pairs of blocks of about this size
SHINGLE_SLICE = 1 << 16


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash over the word shingles of a text, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLE_SLICE):
        some = slice(at, at + SHINGLE_SLICE)
        pieces = map(joined.__getitem__, map(slice, starts[some], ends[some]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.byteswap().view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per document; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for _, _, texts in text_parts(batch.column(1)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id bigint, fp bigint")


def _bucket_keys() -> Column:
    """One key per pair of blocks: the bits of both blocks and the number of the pair."""

    def bits(block: tuple[int, int]) -> Column:
        first, width = block
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))

    keys = []
    for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2)):
        low = F.shiftleft(bits(BLOCKS[j]), BLOCKS[i][1])
        keys.append(F.lit(k << 32).bitwiseOR(low).bitwiseOR(bits(BLOCKS[i])))
    return F.array(*keys)


def _bucketed(distinct: DataFrame, bucket_rows: int) -> DataFrame:
    """(key, block, fp): rows of the buckets with two fingerprints or more, large ones in pairs of blocks."""
    rows = distinct.select("fp", F.explode(_bucket_keys()).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / bucket_rows).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own)
    )
    return rows.select("key", F.explode(pairs).alias("block"), "fp")


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of packed words: bit ``i`` of word ``w`` in row ``b`` is bit ``b`` of fingerprint ``64 w + i``."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(-1, 64)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _within(differing, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with pairs in the radius, and those pairs' bits.

    ``differing(b, alive)`` gives plane ``b`` of the differing bits for the words
    ``alive``.  ``ones``, ``twos``, ``fours`` are the counter; ``over`` marks pairs
    with five or more.
    """
    alive = np.arange(words)
    ones = np.zeros(words, np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    for b in range(64):
        x = differing(b, alive)
        carry = ones & x
        ones ^= x
        carry2 = twos & carry
        twos ^= carry
        over |= (fours & carry2) | (fours & (ones | twos))
        fours |= carry2
        over |= fours & (ones | twos)
        if b % 8 == 7:
            keep = np.flatnonzero(~over)
            if len(keep) < 0.7 * len(alive):
                alive, ones, twos, fours, over = alive[keep], ones[keep], twos[keep], fours[keep], over[keep]
                if not len(alive):
                    break
    return alive, ~over


def _lanes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Pair numbers of the bits set."""
    on = np.flatnonzero(bits)
    if not len(on):
        return on
    row, bit = np.nonzero(np.unpackbits(bits[on].view(np.uint8), bitorder="little").reshape(-1, 64))
    return words[on[row]] * 64 + bit


def shift_links(fps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Local roots for buckets that lie one after another, the largest first."""
    n = len(fps)
    place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left_in = np.repeat(sizes, sizes) - place  # rows of the bucket from this one on
    planes = np.concatenate([_planes(fps), np.zeros((64, 1), np.uint64)], axis=1)
    root = np.arange(n)
    for shift in range(1, int(sizes[0]) if len(sizes) else 0):
        rows = int(sizes[sizes > shift].sum())
        words = -(-rows // 64)
        skip, r = divmod(shift, 64)
        down, up = np.uint64(r), np.uint64(64 - r)
        last = planes.shape[1] - 1

        def differing(b, alive):
            at = np.minimum(alive + skip, last)
            moved = planes[b][at] >> down
            if r:
                moved |= planes[b][np.minimum(at + 1, last)] << up
            return planes[b][alive] ^ moved

        pair = _lanes(*_within(differing, words))
        pair = pair[pair < rows]
        pair = pair[left_in[pair] > shift]
        root = local_roots(n, pair, pair + shift, root)
    return root


def block_links(fps: np.ndarray, queries: int = 128) -> np.ndarray:
    """Local roots of one large bucket: blocks of rows against all rows, word by word."""
    n = len(fps)
    planes = _planes(fps)
    width = planes.shape[1]
    root = np.arange(n)
    for at in range(0, n, queries):
        some = fps[at : at + queries]
        first = at // 64  # earlier words were compared as queries
        spread = np.where((some[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        across = width - first

        def differing(b, alive):
            return planes[b][first + alive % across] ^ spread[alive // across, b]

        words, bits = _within(differing, len(some) * across)
        lane = _lanes(words, bits)
        query, row = lane // (across * 64), first * 64 + lane % (across * 64)
        inside = row < n
        root = local_roots(n, at + query[inside], row[inside], root)
    return root


def forest(fps: np.ndarray, starts: np.ndarray, large: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that join what is within the radius inside each group."""
    ends = np.append(starts[1:], len(fps))
    sizes = ends - starts
    left, right = [], []
    for i in np.flatnonzero(sizes > large):
        own = fps[starts[i] : ends[i]]
        root = block_links(own)
        left.append(own)
        right.append(own[root])
    small = np.flatnonzero(sizes <= large)
    small = small[np.argsort(-sizes[small], kind="stable")]
    if len(small):
        size = sizes[small]
        at = np.repeat(starts[small] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = fps[at]
        root = shift_links(own, size)
        left.append(own)
        right.append(own[root])
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return a[a != b], b[a != b]


def fingerprint_links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ["key", "block"]):
            a, b = forest(table.column("fp").to_numpy().view(np.uint64), starts)
            found = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
            yield pa.RecordBatch.from_arrays(found, ["a", "b"])

    rows = _bucketed(distinct, bucket_rows)
    placed = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per document; component_id is the smallest id linked with it, itself included."""
    found = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept): fingerprint as 16 hex digits, kept the smallest id of a component."""
    found = simhash_components(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
