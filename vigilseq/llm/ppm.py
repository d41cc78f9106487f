"""Document scores by prediction by partial matching over the running bytes of a text.

A text is read as its tokens: words in lower case, each closed by a space, then one empty
word for its end.  The model is a trie of byte contexts.  A byte is predicted from the last
``order`` bytes, which reach back over spaces into the words before, up to the beginning of
the text.  If the context has not seen the byte, the model escapes to the context without
its first byte, and so on, at last to all bytes not yet excluded:

* escape estimation: a context with ``T`` bytes seen, ``D`` different ones, gives
  a seen byte ``n / (T + D)`` and the escape ``D / (T + D)``;
* symbol exclusion: after an escape the bytes of the longer context are left out
  of ``T`` and ``D`` of the shorter one.

The trie is a table of (order, gram, count), a gram being a context and the byte after it,
built and scored by joins, with the scores of all (context, byte) pairs that occur.  Nothing
of it is broadcast; it grows with the corpus.

Documents are cut in chunks of bounded text and vocabulary.  A chunk keeps its documents as
word numbers, its word list, sorted, in ``BUCKETS`` parts by a hash of the word, and its
distinct grams with their counts in training texts.  Word lists and grams are shuffled, not
positions: what fills the corpus is one entry per chunk.  The lists of a bucket meet and are
summed up; grams are summed up, scored and joined back.  A chunk then spells its documents
again and adds up the scores of their grams, and the smoothed frequencies of their words.

Null and empty texts hold only the end token.  Documents without id are never
held out.  Repeated ids and rows give one row each.  Columns other than id and
text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilseq.llm.words import text_parts
from vigilseq.sources.staging import stage

ORDER = 5  # bytes of context
MAX_ORDER = 6
LENGTH_AT = 56  # bit of a packed gram where the length of its context begins
SYMBOLS = 256 - 6 + 1  # bytes that are not white space, and the space that closes a word
CHUNK_WORDS = 500_000  # distinct words of a chunk
CHUNK_BYTES = 48 << 20  # text of a chunk, or one document
GRAM_BYTES = 1 << 20  # text whose grams are sorted at once, or one document
GRAM_ROWS = 1 << 20  # grams of a chunk that wait to be merged
BUCKETS = 1024  # parts of the vocabulary; one part must fit a task
DOC_BITS = 11
DOCS_AT_ONCE = 1 << DOC_BITS  # documents whose grams are looked up at once

WORDS, DOCUMENTS, GRAMS = range(3)  # kinds of rows of a chunk
CHUNKED = "kind int, chunk bigint, id bigint, held_out boolean, bucket int, items binary, cnts binary, gram bigint, n bigint"


def _batch(schema: pa.Schema, rows: int, /, **columns: object) -> pa.RecordBatch:
    """Rows with the given columns; the others are null."""
    arrays = []
    for field in schema:
        values = columns.get(field.name)
        if values is None:
            arrays.append(pa.nulls(rows, field.type))
        elif np.isscalar(values):
            arrays.append(pa.array(np.full(rows, values), field.type))
        else:
            arrays.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _schema(spec: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in spec.split(","))])


class GramCounts:
    """Distinct grams of some texts with their counts in training texts."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.texts: dict[bool, list[bytes]] = {False: [], True: []}
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, body: bytes, held_out: bool) -> None:
        self.texts[held_out].append(body)
        self.size += len(body)
        if self.size >= GRAM_BYTES:
            self._sort()

    def _sort(self) -> None:
        for held_out, bodies in self.texts.items():
            if bodies:
                gram, n = np.unique(running_grams(bodies, self.order)[1], return_counts=True)
                self.parts.append((gram, np.zeros(len(gram), np.int32) if held_out else n.astype(np.int32)))
        self.texts, self.size = {False: [], True: []}, 0
        if sum(len(g) for g, _ in self.parts[1:]) > GRAM_ROWS:
            self._merge()

    def _merge(self) -> None:
        gram = np.concatenate([g for g, _ in self.parts])
        by = np.argsort(gram, kind="stable")  # runs that are sorted already are only merged
        gram = gram[by]
        n = np.concatenate([n for _, n in self.parts])[by]
        self.parts = []
        first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        self.parts = [(gram[first], np.add.reduceat(n, first))]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        self._sort()
        self._merge()
        return self.parts[0]


def chunk_documents(
    docs: DataFrame, held_out: Column, id_col: str, text_col: str, order: int, chunk_words: int = CHUNK_WORDS, buckets: int = BUCKETS
) -> DataFrame:
    """Rows of a chunk: its sorted words with their counts in training texts, a list per bucket; its documents; its grams.

    The words of a chunk are numbered by bucket, then by word.  A document holds the
    numbers of its words in their order; the end token is not stored.
    """
    schema = _schema(CHUNKED)

    def closed(chunk: int, number: dict, rows: list, grams: GramCounts) -> Iterator[pa.RecordBatch]:
        words = sorted(number)
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
        by = np.argsort(bucket, kind="stable")  # by bucket, then by word
        place = np.empty(len(words), np.uint32)
        place[np.fromiter(map(number.__getitem__, words), np.int64, len(words))[by]] = np.arange(len(words))
        end = place[number[b""]]
        number.clear()
        counts = np.zeros(len(words), np.int64)
        for _, held, ids in rows:
            if not held:
                np.add.at(counts, place[ids], 1)
                counts[end] += 1
        bounds = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=buckets))
        items = [b" ".join([words[i] for i in by[x:y].tolist()]) for x, y in zip(bounds, bounds[1:])]
        cnts = [counts[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
        del words
        yield _batch(schema, len(items), kind=WORDS, chunk=chunk, bucket=bucket[by][bounds[:-1]], items=items, cnts=cnts)
        del items, cnts
        for at in range(0, len(rows), 2_000):
            key, held, ids = zip(*rows[at : at + 2_000])
            yield _batch(schema, len(key), kind=DOCUMENTS, chunk=chunk, id=key, held_out=held, items=[place[x].tobytes() for x in ids])
        rows.clear()
        gram, n = grams.close()
        for at in range(0, len(gram), 50_000):
            some = slice(at, at + 50_000)
            yield _batch(schema, len(gram[some]), kind=GRAMS, chunk=chunk, gram=gram[some], n=n[some])
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, rows, size, grams = TaskContext.get().partitionId() << 24, {b"": 0}, [], 0, GramCounts(order)
        for batch in batches:
            texts = (text for _, _, part in text_parts(batch.column(2)) for text in part)
            for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                tokens = text.lower().split()
                for word in set(tokens).difference(number):
                    number[word] = len(number)
                rows.append((key, out, np.fromiter(map(number.__getitem__, tokens), np.uint32, len(tokens))))
                grams.add(body(tokens), out)
                size += len(text)
                if len(number) >= chunk_words or size >= CHUNK_BYTES:
                    yield from closed(chunk, number, rows, grams)
                    chunk, number, rows, size, grams = chunk + 1, {b"": 0}, [], 0, GramCounts(order)
        if rows:
            yield from closed(chunk, number, rows, grams)

    kept = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")
    )
    return kept.mapInArrow(run, CHUNKED)


def body(tokens: list[bytes]) -> bytes:
    """Words, each closed by a space; the space of the end token comes after."""
    return b" ".join(tokens) + b" " if tokens else b""


def running_grams(bodies: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each body and the space that ends it: the body's number and the gram.

    A gram is its context's length, the context and the byte, packed in one integer with the
    byte last.  A space before the body is its first context.
    """
    lengths = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    data = np.frombuffer(bytes(7) + b" " + b"  ".join(bodies) + b" ", np.uint8)
    # The eight bytes up to each place, the place's own byte last.
    upto = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).view(">u8")[:, 0] if len(data) >= 8 else np.zeros(0, ">u8")
    starts = np.cumsum(lengths + 1) - lengths  # the first byte after the space
    own = np.ones(len(data) - 7, bool)
    own[starts - 1] = False
    gram = (upto[own].astype(np.uint64) & np.uint64((1 << 8 * (order + 1)) - 1)) | np.uint64(order << LENGTH_AT)
    first = np.cumsum(lengths) - lengths
    for length in range(1, order):  # bytes with less before them
        at = first[lengths >= length] + length - 1
        gram[at] = (gram[at] & np.uint64((1 << 8 * (length + 1)) - 1)) | np.uint64(length << LENGTH_AT)
    return np.repeat(np.arange(len(bodies)), lengths), gram.view(np.int64)


SUMMED = "chunk bigint, bucket int, cnts binary, tokens bigint, types bigint"


def sum_vocabulary(lists: DataFrame) -> DataFrame:
    """(chunk, bucket, cnts): the counts over all chunks of the words of each list, in the list's order.

    One more row per bucket holds its ``tokens`` and distinct training words, ``types``.
    """
    schema = _schema(SUMMED)

    def closed(counts: dict, uses: list) -> Iterator[pa.RecordBatch]:
        yield _batch(schema, 1, tokens=sum(counts.values()), types=sum(n > 0 for n in counts.values()))
        for at in range(0, len(uses), 1_000):
            chunk, bucket, names = zip(*uses[at : at + 1_000])
            found = [np.fromiter(map(counts.__getitem__, own), np.int64, len(own)).tobytes() for own in names]
            yield _batch(schema, len(chunk), chunk=chunk, bucket=bucket, cnts=found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, uses, last = {}, [], None
        for batch in batches:
            for chunk, bucket, items, cnts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "items", "cnts"))):
                if bucket != last and uses:
                    yield from closed(counts, uses)
                    counts, uses = {}, []
                last = bucket
                names = items.split(b" ")
                for word, n in zip(names, np.frombuffer(cnts, np.int64).tolist()):
                    counts[word] = counts.get(word, 0) + n
                uses.append((chunk, bucket, names))
        if uses:
            yield from closed(counts, uses)

    placed = lists.select("chunk", "bucket", "items", "cnts").repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(run, SUMMED)


def trie(grams: DataFrame) -> DataFrame:
    """(k, gram, n) for every context of up to ``order`` bytes and the byte after it, from the longest grams (gram, n)."""

    def cut(k: Column) -> Column:
        low = F.element_at(F.array(*[F.lit((1 << (8 * (i + 1))) - 1) for i in range(MAX_ORDER + 1)]), k + 1)
        return F.struct(k.alias("k"), F.col("gram").bitwiseAND(low).alias("gram"))

    length = F.shiftrightunsigned("gram", LENGTH_AT).cast("int")
    shorter = grams.select(F.explode(F.transform(F.sequence(F.lit(0), length), cut)).alias("g"), "n")
    return shorter.select("g.k", "g.gram", "n").groupBy("k", "gram").agg(F.sum("n").alias("n"))


def score_trie(nodes: DataFrame, order: int) -> DataFrame:
    """(gram, lp): log10 probability of the byte after its context, from a staged ``trie``.

    Contexts are those that bytes of a text have: full ones, and shorter ones at its beginning.  Orders are scored from the shortest up.  ``lp`` is the score from this context
    on; ``rest`` the score after it was escaped, with its bytes excluded.
    """
    context = Window.partitionBy("ctx")
    tables, below = [], None
    for k in range(order + 1):
        rows = nodes.filter(F.col("k") == k).select("gram", "n", F.shiftrightunsigned("gram", 8).alias("ctx"))
        seen = F.col("n") > 0
        if below is None:
            joined = rows.withColumns({"n_s": F.lit(0), "lp_s": F.lit(0.0), "rest_s": F.lit(0.0), "t_s": F.lit(0), "d_s": F.lit(0)})
        else:
            suffix = below.select(
                F.col("gram").alias("s"), F.col("n").alias("n_s"), F.col("lp").alias("lp_s"), F.col("rest").alias("rest_s"),
                F.col("t").alias("t_s"), F.col("d").alias("d_s"),
            )
            joined = rows.withColumn("s", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(suffix, "s")
        found = joined.withColumns(
            {
                "t": F.sum("n").over(context),
                "d": F.sum(seen.cast("long")).over(context),
                "x": F.sum(F.when(seen, F.col("n_s")).otherwise(0)).over(context),
            }
        )
        # What is left of the shorter context without the bytes of this one.
        escape = F.when(F.col("d") < SYMBOLS, F.col("d")).otherwise(0)
        if k == 0:
            rest = -F.log10(F.greatest(F.lit(SYMBOLS) - F.col("d"), F.lit(1)).cast("double"))
            unseen = F.lit(-float(np.log10(SYMBOLS)))
        else:
            new = F.when(F.col("d_s") < SYMBOLS, F.col("d_s") - F.col("d")).otherwise(0)
            total = (F.col("t_s") - F.col("x") + new).cast("double")
            rest = F.when(F.col("n_s") > 0, F.log10(F.col("n_s") / total)).otherwise(
                F.col("rest_s") + F.when(new > 0, F.log10(new / total)).otherwise(0.0)
            )
            unseen = F.col("lp_s")
        whole = (F.col("t") + escape).cast("double")
        lp = (
            F.when(seen, F.log10(F.col("n") / whole))
            .when(F.col("t") == 0, unseen)
            .otherwise(F.log10(escape / whole) + F.col("rest"))
        )
        found = found.withColumn("rest", F.when(seen | (F.col("t") == 0), F.lit(0.0)).otherwise(rest)).withColumn("lp", lp)
        below = stage(found.select("gram", "n", "t", "d", "lp", "rest"), f"trie{k}")
        reaches = F.shiftrightunsigned("gram", 8 * k).bitwiseAND(F.lit(255)) == ord(" ")
        if k == order or k:  # a shorter context stands at the beginning of a text, after its space
            own = below if k == order else below.filter(reaches)
            tables.append(own.select(F.col("gram").bitwiseOR(F.lit(k << LENGTH_AT)).alias("gram"), "lp"))
    scores = tables[0]
    for table in tables[1:]:
        scores = scores.unionByName(table)
    return scores


def score_grams(grams: DataFrame, order: int) -> DataFrame:
    """(chunk, gram, lp): scores of the staged grams (chunk, gram, n) of each chunk."""
    total = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    nodes = stage(trie(total), "trie", "k")
    return grams.select("chunk", "gram").join(score_trie(nodes, order), "gram").select("chunk", "gram", "lp")


def score_documents(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    chunk_words: int = CHUNK_WORDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Score every document with a model of the documents that are not ``held_out``.

    Columns: id, held_out, n_tokens, n_known (tokens that occur in training),
    train_tokens, base_score (smoothed token frequencies), score (this model), both log10.
    """
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"order must be from 0 to {MAX_ORDER}")
    chunks = stage(chunk_documents(docs, held_out, id_col, text_col, order, chunk_words, buckets), "chunks", "kind", "zstd")
    summed = stage(sum_vocabulary(chunks.filter(F.col("kind") == WORDS)), "vocabulary")
    size = summed.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = int(size[0]), int(size[1])
    below = float(tokens + 0.5 * (types + 1))
    scored = score_grams(chunks.filter(F.col("kind") == GRAMS).select("chunk", "gram", "n"), order)

    def total(rows: pa.Table, found: pa.Table) -> pa.Table:
        words = found.filter(pc.is_valid(found.column("cnts"))).sort_by("bucket")
        cnt = np.frombuffer(b"".join(words.column("cnts").to_pylist()), np.int64)
        base = np.log10((cnt + 0.5) / below)
        known = found.select(["gram", "lp"])
        known = known.filter(pc.is_valid(known.column("gram"))).sort_by("gram")
        gram, lp = known.column("gram").to_numpy(), known.column("lp").to_numpy()
        del known, words
        kind = rows.column("kind")
        lists = rows.filter(pc.equal(kind, WORDS)).sort_by("bucket")
        names = [word for items in lists.column("items").to_pylist() for word in items.split(b" ")]
        end = names.index(b"")
        documents = rows.filter(pc.equal(kind, DOCUMENTS))
        items = documents.column("items").to_pylist()
        n = len(items)
        n_tokens, n_known, base_score, score = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        at = 0
        while at < n:
            own, size, first = [], 0, at
            while at < n and size < GRAM_BYTES and at - first < DOCS_AT_ONCE:
                own.append(np.frombuffer(items[at], np.uint32))
                size += 8 * len(own[-1])  # a word and its space, about
                at += 1
            here = slice(first, at)
            n_tokens[here] += [len(x) for x in own]
            numbers, of = np.concatenate(own), np.repeat(np.arange(len(own)), n_tokens[here] - 1)
            n_known[here] = np.bincount(of, cnt[numbers] > 0, len(own)) + (cnt[end] > 0)
            base_score[here] = np.bincount(of, base[numbers], len(own)) + base[end]
            score[here] = _gram_scores([body([names[i] for i in x.tolist()]) for x in own], gram, lp, order)
        return pa.table(
            {
                "id": documents.column("id"),
                "held_out": documents.column("held_out"),
                "n_tokens": pa.array(n_tokens),
                "n_known": pa.array(n_known),
                "train_tokens": pa.array(np.full(n, tokens)),
                "base_score": pa.array(base_score),
                "score": pa.array(score),
            }
        )

    whole = chunks.filter(F.col("kind") != GRAMS).select("kind", "chunk", "id", "held_out", "bucket", "items")
    nothing = F.lit(None)
    values = summed.filter("chunk is not null").select("chunk", "bucket", "cnts", nothing.cast("bigint").alias("gram"), nothing.cast("double").alias("lp"))
    values = values.unionByName(scored.select("chunk", nothing.cast("int").alias("bucket"), nothing.cast("binary").alias("cnts"), "gram", "lp"))
    return whole.groupBy("chunk").cogroup(values.withColumnRenamed("chunk", "of").groupBy("of")).applyInArrow(
        total,
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def _gram_scores(bodies: list[bytes], gram: np.ndarray, lp: np.ndarray, order: int) -> np.ndarray:
    """Sum of the scores of each body's grams, which are looked up in the order of their values."""
    of, own = running_grams(bodies, order)
    # Grams leave enough bits for the number of a body, so that both are sorted at once.
    packed = own & ((1 << 8 * (order + 1)) - 1) | (own >> LENGTH_AT) << 8 * (order + 1)
    if 8 * (order + 1) + 3 + DOC_BITS > 63:
        return np.bincount(of, lp[np.searchsorted(gram, own)], len(bodies))
    keys = np.sort(packed << DOC_BITS | of)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times, keys = np.diff(np.append(new, len(keys))), keys[new]
    own = keys >> DOC_BITS
    own = own & ((1 << 8 * (order + 1)) - 1) | (own >> 8 * (order + 1)) << LENGTH_AT
    return np.bincount(keys & ((1 << DOC_BITS) - 1), lp[np.searchsorted(gram, own)] * times, len(bodies))
