"""Near-duplicate vectors by product quantisation.

Equal vectors are reduced to one with their number.  The others are kept in coarse
inverted lists: a vector is coded as the difference to its list's centre, one byte per
subspace.  A query meets a list as tables of its distances to all codewords; adding up
table entries gives its asymmetric distance to every code.  A vector whose code is off
by ``e`` can only be a partner if that distance is at most ``radius + e``, so the codes
lose nothing; what passes is compared by exact cosine in double precision.

Probes: a query goes to every list whose border with its own is nearer than ``margin``
(distance to the bisecting plane of the two centres).  A margin equal to the radius is
complete for any data; the default takes the part of a difference that shows along one
direction as three standard deviations, and its recall is measured in the tests.

Lists are numbered, and so are the blocks of lists with many vectors; a vector visits
only its own block and later ones, so each pair is looked at once.  A block reports per
vector the number of partners and one link to its local component, never pairs.

Vectors of each length have lists, codewords and a margin of their own.  Centres and
codewords come from a sample of at most ``SAMPLE`` vectors and ``SAMPLE_NUMBERS`` numbers;
their number is bounded (``MAX_LISTS``, 256 per subspace), and every vector is indexed.

Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing;
nor do vectors of different length, or without id.  Repeated rows count as vectors of
their own.  Columns other than id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseq.llm.common import local_roots, sorted_groups
from vigilseq.llm.components import components
from vigilseq.sources.staging import stage

COSINE = 0.95
SAMPLE = 16_384
SAMPLE_NUMBERS = 1 << 21  # numbers in the vectors of a sample
MAX_LISTS = 4_096
SUBSPACE = 4  # numbers per byte of code
BLOCK_ROWS = 2_048
DEVIATIONS = 3.0


@dataclass(frozen=True)
class Index:
    centres: np.ndarray  # (lists, size)
    words: np.ndarray  # (subspaces, 256, SUBSPACE)
    blocks: np.ndarray  # blocks of each list

    @property
    def size(self) -> int:
        return self.centres.shape[1]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = (centres**2).sum(1)[None, :] - 2 * points @ centres.T
    return gap.argmin(1)


def kmeans(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most ``k`` groups; starts from distinct points at even steps."""
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(7).permutation(len(distinct))[:k]].astype(np.float32)
    for _ in range(rounds):
        own = _nearest(points, centres)
        held = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, column, minlength=k) for column in points.T], axis=1)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres).astype(np.float32)
    return centres


def train(sample: np.ndarray, lists: int) -> Index:
    """Centres and codewords from unit vectors, their size a multiple of ``SUBSPACE``."""
    centres = kmeans(sample, lists)
    rest = sample - centres[_nearest(sample, centres)]
    words = np.zeros((sample.shape[1] // SUBSPACE, 256, SUBSPACE), np.float32)
    for m in range(len(words)):
        found = kmeans(rest[:, m * SUBSPACE : (m + 1) * SUBSPACE], 256)
        words[m, : len(found)] = found
        words[m, len(found) :] = found[0]
    return Index(centres, words, np.ones(len(centres), np.int64))


def units(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors of one length in double precision, padded with zeros to ``size``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    numbers = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    out = np.zeros((len(column), size))
    out[:, : numbers.shape[1]] = numbers
    out /= np.abs(out).max(axis=1, keepdims=True)  # no overflow in the square
    return out / np.sqrt((out**2).sum(1, keepdims=True))


def probes(vectors: np.ndarray, index: Index, margin: float, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own list of each vector, and which lists are near enough to visit; ``apart`` are the distances between the lists."""
    gap = (index.centres.astype(np.float64) ** 2).sum(1)[None, :] - 2 * vectors @ index.centres.T
    own = gap.argmin(1)
    return own, (gap - gap[np.arange(len(own)), own][:, None]) / (2 * apart[own]) <= margin


def distances(centres: np.ndarray) -> np.ndarray:
    """Distance of each two centres, never quite zero; computed once per task."""
    square = (centres.astype(np.float64) ** 2).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * centres.astype(np.float64) @ centres.T, 1e-12))


def encode(rest: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per subspace, and the length of what the code leaves out."""
    codes = np.empty((len(rest), len(words)), np.uint8)
    left = np.zeros(len(rest))
    for m, book in enumerate(words):
        part = rest[:, m * SUBSPACE : (m + 1) * SUBSPACE]
        codes[:, m] = _nearest(part, book)
        left += ((part - book[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(left)


def compare(queries: np.ndarray, base: np.ndarray, centre: np.ndarray, words: np.ndarray, cosine: float, step: int = 256):
    """(first query, rows, partners): exact partners of some queries at a time, found over the codes of ``base``."""
    codes, error = encode(base - centre, words)
    limit = (math.sqrt(max(0.0, 2 - 2 * cosine)) + error + 1e-4) ** 2
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        rest = some - centre
        distance = np.zeros((len(some), len(base)), np.float32)
        for m, book in enumerate(words):
            part = rest[:, m * SUBSPACE : (m + 1) * SUBSPACE]
            table = (part**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * part @ book.T
            distance += table.astype(np.float32)[:, codes[:, m]]
        near = distance <= limit
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if len(rows):
            exact = (some[rows] @ base[columns].T >= cosine) & near[np.ix_(rows, columns)]
            row, column = np.nonzero(exact)
            yield at, rows[row] + at, columns[column]


def _placed(nodes: DataFrame, index: Index, margin: float) -> DataFrame:
    """Rows (list, block, base, node, times, vector) of each vector in its own block and where it is a query."""
    names = ["list", "block", "base", "node", "times", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = distances(index.centres)
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            vectors = units(batch.column(2), index.size)
            own, visited = probes(vectors, index, margin, apart)
            visited &= np.arange(len(index.centres))[None, :] > own[:, None]
            block = np.abs(node) % index.blocks[own]
            row, to = np.nonzero(visited)
            count = index.blocks[to]
            parts = [(np.arange(len(node)), own, block, np.ones(len(node), bool))]
            parts.append((np.repeat(row, count), np.repeat(to, count), _counting(count), np.zeros(count.sum(), bool)))
            later = index.blocks[own] - 1 - block
            after = np.repeat(block + 1, later) + _counting(later)
            parts.append((np.repeat(np.arange(len(node)), later), np.repeat(own, later), after, np.zeros(later.sum(), bool)))
            row, to, block, base = (np.concatenate(p) for p in zip(*parts))
            columns = [pa.array(to.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(base)]
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*columns, taken.column(0), taken.column(1), taken.column(2)], names)

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.mapInArrow(run, f"list int, block int, base boolean, node bigint, times bigint, vector {kind}")


def _counting(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _links(placed: DataFrame, index: Index, cosine: float) -> DataFrame:
    """(node, links, root): partners of a vector in one block, and the least node it hangs together with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ["list", "block"], 20_000):
            for start, end in zip(starts, np.append(starts[1:], table.num_rows)):
                found = block(table.slice(start, end - start))
                if found is not None:
                    yield found

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        is_base = rows.column("base").to_numpy()
        order = np.concatenate((np.flatnonzero(is_base), np.flatnonzero(~is_base)))
        n = int(is_base.sum())
        node, times = rows.column("node").to_numpy()[order], rows.column("times").to_numpy()[order]
        if not n:
            return None
        vectors = units(rows.column("vector"), index.size)[order]
        centre = index.centres[rows.column("list")[0].as_py()].astype(np.float64)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for _, row, column in compare(vectors, vectors[:n], centre, index.words, cosine):
            real = row != column
            row, column = row[real], column[real]
            links += np.bincount(row, times[column], minlength=len(node)).astype(np.int64)
            query = row >= n  # pairs inside the block come from both sides
            links += np.bincount(column[query], times[row[query]], minlength=len(node)).astype(np.int64)
            root = local_roots(len(node), row, column, root)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["node", "links", "root"])

    sorted_rows = placed.repartition("list", "block").sortWithinPartitions("list", "block")
    return sorted_rows.mapInArrow(run, "node bigint, links bigint, root bigint")


def _links_of_length(
    nodes: DataFrame, length: int, count: int, cosine: float, margin: float | None, lists: int | None, block_rows: int, sample: int
) -> DataFrame:
    """``_links`` of the ``count`` distinct vectors (node, times, vector) of one length, with lists, codes and margin of their own."""
    size = -(-length // SUBSPACE) * SUBSPACE
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    margin = DEVIATIONS * radius / math.sqrt(length) if margin is None else margin

    drawn = nodes.orderBy(F.xxhash64("vector")).limit(max(1, min(sample, SAMPLE_NUMBERS // size))).select("vector").toArrow().column(0)
    index = train(units(drawn, size).astype(np.float32), min(MAX_LISTS, lists or math.isqrt(count)))

    def own_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = distances(index.centres)
        for batch in batches:
            if batch.num_rows:
                own, _ = probes(units(batch.column(0), size), index, margin, apart)
                held = np.bincount(own, minlength=len(index.centres))
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], ["list", "n"])

    held = nodes.select("vector").mapInArrow(own_lists, "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n"))
    blocks = np.ones(len(index.centres), np.int64)
    for row in held.collect():  # at most MAX_LISTS
        blocks[row["list"]] = max(1, -(-row["n"] // block_rows))
    index = Index(index.centres, index.words, blocks)
    return _links(_placed(nodes, index, margin), index, cosine)


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    margin: float | None = None,
    lists: int | None = None,
    block_rows: int = BLOCK_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, n_links, component_id) per vector; component_id is the smallest id reachable by links, itself included."""
    vector = F.col(vector_col)
    good = F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good &= finite & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.when(F.coalesce(good, F.lit(False)), vector).alias("vector"))
    distinct = rows.filter("vector is not null").groupBy("vector").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("least"))
    nodes = stage(distinct.select(F.monotonically_increasing_id().alias("node"), "times", "vector", "least"), "vectors")

    found = None
    for length, count in sorted(map(tuple, nodes.groupBy(F.size("vector")).count().filter("count > 1").collect())):  # a row per length
        own = nodes.filter(F.size("vector") == length).select("node", "times", "vector")
        links = stage(_links_of_length(own, length, count, cosine, margin, lists, block_rows, sample), "links")
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = nodes.limit(0).select("node", F.col("times").alias("links"), F.col("node").alias("root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = nodes.join(links, "node", "left").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    joined = joined.select(
        "vector", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")
    )
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select(F.col("vector").alias("own"), "n_links", "component_id")
    return rows.join(named, rows["vector"] == named["own"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
