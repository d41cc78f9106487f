"""Nearest neighbours by counting collisions of single projections.

Unit vectors are projected on ``PROJECTIONS`` random lines, and the places on each line
are kept in a sorted array.  Two vectors at distance d lie on a line |N(0, 1)| * d apart.
A query opens a window around its own place on every line, ``WIDTH`` * R to each side; a
vector inside the window collides there.  Vectors that collide on ``COLLISIONS`` lines or
more are verified by their cosine.  R grows in steps (virtual rehashing: each step only
counts what its wider windows add) until the wanted number of vectors verified are within
R.  A vector within R collides on 87 % of the lines, so that it is passed over once in
some hundreds of cases.  When the windows hold everything and too few vectors were
verified, all are.

Vectors are dealt into blocks by a hash, so copies spread, and each block has its own
arrays.  A query first searches its own block; its last neighbour there bounds R in all
others, where a search mostly ends after a few steps.  A block answers a part of the
queries at a time and returns the wanted number of rows per query at most.

Distances follow from cosines, so nearness is the largest cosine.  Scores are sums in the
order of the numbers, in double precision, and the same for equal vectors; ties go to the
smaller id, then row.

Vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do
rows without id.  Only vectors of equal length are compared.  Rows with one id are vectors
of their own, and only the query's own row is left out.  With fewer candidates than wanted
all are returned.  Columns other than id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilseq.llm.common import BROADCAST_ROWS, look_up
from vigilseq.sources.staging import stage

PROJECTIONS = 64
COLLISIONS = 47  # three deviations below the mean of a vector within R
WIDTH = 1.5
RADII = 0.05 * 1.15 ** np.arange(28)  # up to 2.2; unit vectors are 2 apart at most
BLOCK_NUMBERS = 1 << 18  # numbers in the vectors of a block
LEAST_ROWS = 256
QUERY_NUMBERS = 1 << 20  # numbers in the queries that a block answers at a time
QUERIES = 128  # queries whose windows are laid out at once
SLACK = 1e-9  # cosines this near are compared by their exact sums
FOUND = "query bigint, query_id bigint, row bigint, id bigint, score double"


def usable(vector: str) -> Column:
    """Whether a vector is not empty, finite and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & finite & F.exists(vector, lambda x: x != 0)


def in_order(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot products added up number by number."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        total += rows[:, i] * other[..., i]
    return total


class Block:
    """Vectors of one length with their sorted projections."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[order], rows[order]
        self.vectors, self.norms, self.units = _scaled(vectors[order])
        self.lines = np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], PROJECTIONS))
        places = (self.units @ self.lines).T
        by_place = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, by_place, axis=1)
        self.order = by_place.astype(np.int32).ravel()

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end (query, radius, line) of the windows, as places in ``order``."""
        at = queries @ self.lines
        shape = len(queries), len(RADII), PROJECTIONS
        low, high = np.empty(shape, np.int64), np.empty(shape, np.int64)
        for j, line in enumerate(self.places):
            low[:, :, j] = np.searchsorted(line, at[:, j, None] - WIDTH * RADII, side="left")
            high[:, :, j] = np.searchsorted(line, at[:, j, None] + WIDTH * RADII, side="right")
        return low + np.arange(PROJECTIONS) * len(self.ids), high + np.arange(PROJECTIONS) * len(self.ids)

    def nearest(self, low: np.ndarray, high: np.ndarray, unit: np.ndarray, own: int, bound: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of what was verified until the search ended; ``own`` is left out."""
        counts = np.zeros(len(self.ids), np.int64)
        waiting = self.rows != own
        some, cosines = [], []
        best = np.zeros(0)
        begin = end = (low[0] + high[0]) // 2
        for step, radius in enumerate(RADII):
            edges = np.concatenate((low[step], end)).tolist(), np.concatenate((begin, high[step])).tolist()
            added = [self.order[a:b] for a, b in zip(*edges) if a < b]
            begin, end = low[step], high[step]
            if added:
                counts += np.bincount(np.concatenate(added), minlength=len(counts))
            ready = np.flatnonzero(waiting & (counts >= COLLISIONS))
            if radius > 2 and len(best) < wanted:
                ready = np.flatnonzero(waiting)
            if len(ready):
                waiting[ready] = False
                some.append(ready)
                cosines.append(self.units[ready] @ unit)
                best = np.concatenate((best, cosines[-1]))
                best = -np.partition(-best, wanted - 1)[:wanted] if len(best) > wanted else best
            near = 1 - radius**2 / 2  # cosine at this distance
            if bound > near or (len(best) >= wanted and best.min() >= near):
                break
        if not some:
            return np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(some), np.concatenate(cosines)

    def search(self, vectors: np.ndarray, own: np.ndarray, bounds: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, place in the block, score) of the nearest vectors, nearest first; ``bounds`` are least scores."""
        vectors, norms, units = _scaled(vectors)
        found = []
        for at in range(0, len(vectors), QUERIES):
            low, high = self.windows(units[at : at + QUERIES])
            for i in range(at, min(at + QUERIES, len(vectors))):
                places, cosines = self.nearest(low[i - at], high[i - at], units[i], own[i], bounds[i], wanted)
                if len(cosines) > wanted:
                    least = -np.partition(-cosines, wanted - 1)[wanted - 1]
                    places = places[cosines >= least - SLACK]
                scores = in_order(self.vectors[places], vectors[i]) / (norms[i] * self.norms[places])
                fits = scores >= bounds[i]
                places, scores = places[fits], scores[fits]
                order = np.lexsort((places, -scores))[:wanted]  # places are in the order of ids
                found.append((np.full(len(order), i), places[order], scores[order]))
        return tuple(np.concatenate(x) for x in zip(*found))


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors brought near one by powers of two, which changes no digit, their norms, and unit vectors."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    norms = np.sqrt(in_order(vectors, vectors))
    return vectors, norms, vectors / norms[:, None]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _answer(wanted: int):
    def run(key: tuple, base: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "query_id", "row", "id", "score"]
        if not base.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        ids, rows = (base.column(c).to_numpy() for c in ("id", "row"))
        block = Block(ids, rows, _matrix(base.column("vector")))
        own, bounds = queries.column("query").to_numpy(), queries.column("bound").to_numpy()
        number, place, score = block.search(_matrix(queries.column("vector")), own, bounds, wanted)
        columns = [own[number], queries.column("query_id").to_numpy()[number], block.rows[place], block.ids[place], score]
        return pa.table(dict(zip(names, map(pa.array, columns))))

    return run


def _searched(base: DataFrame, tasks: DataFrame, wanted: int) -> DataFrame:
    """``FOUND`` rows of the tasks in the blocks they name."""
    keys = ["size", "block", "part"]
    spread = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = spread.select(*keys, "row", "id", "vector").groupBy(*keys)
    return left.cogroup(tasks.select(*keys, "query", "query_id", "vector", "bound").groupBy(*keys)).applyInArrow(_answer(wanted), FOUND)


def _ranked(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def nearest_vectors(
    table: DataFrame,
    queries: Column,
    wanted: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_numbers: int = BLOCK_NUMBERS,
    query_numbers: int = QUERY_NUMBERS,
) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``queries`` selects, its nearest other rows, nearest first."""
    rows = table.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    good = stage(rows.filter(F.col("id").isNotNull() & usable("vector")).withColumn("size", F.size("vector")), "vectors")
    counts = good.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    block_rows = F.greatest(F.lit(LEAST_ROWS), F.floor(block_numbers / F.col("size")))
    part_rows = F.greatest(F.lit(LEAST_ROWS), F.floor(query_numbers / F.col("size")))
    sizes = counts.filter("asked > 0").select(
        "size",
        F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"),
        F.ceil(F.col("asked") / part_rows).cast("int").alias("parts"),
    )
    placed = look_up(good, stage(sizes, "sizes"), "size", BROADCAST_ROWS).filter("blocks is not null")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asked = placed.filter("asks").withColumnsRenamed({"row": "query", "id": "query_id"})
    part = F.pmod(F.xxhash64("query", F.lit(1)), F.col("parts")).cast("int")
    asked = stage(asked.select("query", "query_id", "vector", "size", "blocks", "block", part.alias("part")), "queries")

    own = stage(_searched(placed, asked.withColumn("bound", F.lit(-2.0)), wanted), "own")
    last = own.groupBy("query").agg(F.when(F.count(F.lit(1)) >= wanted, F.min("score")).otherwise(-2.0).alias("bound"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
    tasks = asked.join(last, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(-2.0)))
    tasks = tasks.withColumn("block", F.explode(others))
    both = own.unionByName(_searched(placed, tasks, wanted))
    return _ranked(both, wanted).select("query_id", "rank", "id", "score")
