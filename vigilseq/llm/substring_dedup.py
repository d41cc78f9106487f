"""Removal of repeated word sequences with one FM-index per shard.

A window is ``WINDOW`` consecutive words.  Words covered by a window whose sequence
also starts earlier (smaller id, or earlier in the same document) are removed.

Each window has an anchor, the least hash of the ``ANCHOR``-word sequences in it, so
equal windows have equal anchors.  A segment is a maximal run of windows with the same
anchor.  Windows thus divide into shards by anchor, and no two shards need comparing.

1. Documents are cut in segments.  A task keeps one of each distinct segment it sees
   and reports the others as repeats.  Rows meet by anchor, where again the first of
   equal segments stays.  An anchor that occurs once cannot hold a repeated window.
2. The distinct segments of the other anchors are read from their documents and
   indexed per shard of bounded size.  All segments are streamed backwards through
   the index of their shard; a window's match interval gives its earliest start.
3. Repeats are gathered per document and removed.

Very common anchors are found in a sample of the documents; their segments are cut to
single windows, each under the hash of its own words, so that one anchor never
fills a shard.  Which anchors the sample finds changes the plan, not the result.

Documents are ordered by id, those with the same id by a hash of their text, so a
repeated row is the same document and does not repeat itself.  An id of null comes
first.  Null texts have no words.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseq.llm.common import LEAST, sorted_groups, text_bytes
from vigilseq.llm.fm_index import FMIndex, matching_windows
from vigilseq.llm.words import run_hashes, text_parts, word_hashes
from vigilseq.sources.staging import stage

WINDOW = 20
ANCHOR = 6
SHARD_WORDS = 1 << 20  # words of the segments of one shard
TASK_SEGMENTS = 1 << 20  # segments a task holds to find its own repeats
SAMPLE = 64  # one document in so many is looked at for common anchors
HOT_ROWS = 1 << 16  # expected rows of an anchor that is cut to windows

SEGMENT = "anchor bigint, content bigint, id bigint, tag int, start int, n int, times int"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("id"),
        F.hash(F.coalesce(text, F.lit("")).cast("binary")).alias("tag"),
        text.alias("text"),
    )


def cut_segments(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """Segments of texts given by word hashes: anchor, hash of the words, first word, windows."""
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    grams = run_hashes(hashes, np.arange(len(hashes) - anchor + 1), anchor)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
    at = views.argmin(axis=1) + np.arange(len(views))
    lengths = np.diff(offsets)
    inside = np.repeat(offsets[1:], lengths)[: len(at)] >= np.arange(len(at)) + window
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new | ~inside), len(at))
    windows = ends[np.searchsorted(ends, first, side="right")] - first
    return grams[at[first]], run_hashes(hashes, first, windows + window - 1), first, windows


def _segments(keyed: DataFrame, hot: np.ndarray, window: int, anchor: int) -> DataFrame:
    """Distinct segments of each task (``times`` 1 or 2) and the words known to repeat (``times`` 0)."""
    names = ["anchor", "content", "id", "tag", "start", "n", "times"]

    def reduced(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, content, doc, tag, start, n = (np.concatenate(p) for p in zip(*parts))
        place = np.lexsort((start, tag, doc, content, key))
        key, content, doc, tag, start, n = (x[place] for x in (key, content, doc, tag, start, n))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        bounds = np.append(np.flatnonzero(first), len(key))
        times = np.minimum(np.diff(bounds), 2).astype(np.int32)
        kept = [x[first] for x in (key, content, doc, tag, start, n)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, _signed(kept)), pa.array(times)], names)
        rest = _later(first, doc, tag, start)
        if len(rest):
            rest = rest[np.lexsort((start[rest], tag[rest], doc[rest]))]
            doc, tag, begin, end = merge_spans(doc[rest], tag[rest], start[rest], start[rest] + n[rest])
            spread = np.random.default_rng(len(doc)).integers(-(2**63), 2**63, len(doc))  # passed on wherever they land
            zero = np.zeros(len(doc), np.int64)
            columns = [spread, zero, doc, tag, begin, (end - begin).astype(np.int32), zero.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, high, texts in text_parts(batch.column(2)):
                hashes, offsets = word_hashes(texts)
                key, content, first, windows = cut_segments(hashes, offsets, window, anchor)
                if len(hot):
                    common = np.isin(key, hot)
                    if common.any():
                        several = windows[common]
                        at = np.repeat(first[common], several) + _counting(several)
                        own = run_hashes(hashes, at, window)
                        key = np.concatenate((key[~common], own))
                        content = np.concatenate((content[~common], own))
                        first = np.concatenate((first[~common], at))
                        windows = np.concatenate((windows[~common], np.ones(len(at), np.int64)))
                row = np.searchsorted(offsets, first, side="right") - 1
                start = (first - offsets[row]).astype(np.int32)
                n = (windows + window - 1).astype(np.int32)
                parts.append([key, content, doc[low:high][row], tag[low:high][row], start, n])
                held += len(key)
                if held >= TASK_SEGMENTS:
                    yield from reduced(parts)
                    parts, held = [], 0
        if held:
            yield from reduced(parts)

    return keyed.mapInArrow(run, SEGMENT)


def _later(first: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Rows that are not the first of their segment, nor the same place again (a repeated input row)."""
    at = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return np.flatnonzero(np.any([x != x[at] for x in place], axis=0))


def _signed(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def merge_spans(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Unions of touching word spans; the input is sorted by document and begin."""
    if not len(doc):
        return doc, tag, begin, end
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    group = np.cumsum(new)
    wide = np.int64(1) << 32  # spans of a later document start above all ends of earlier ones
    reach = np.maximum.accumulate(end + group * wide)
    new[1:] |= (begin + group * wide)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tag[first], begin[first], (reach[last] - group[last] * wide).astype(begin.dtype)


def _hot_anchors(keyed: DataFrame, window: int, anchor: int, hot_rows: int) -> np.ndarray:
    """Anchors common in a sample of the documents: a bounded list, as each has many rows there."""
    sample = keyed.filter(F.pmod(F.xxhash64("id", "tag"), F.lit(SAMPLE)) == 0)
    rows = _segments(sample, np.zeros(0, np.uint64), window, anchor).filter("times > 0")
    few = F.count(F.lit(1)) >= max(2, hot_rows // SAMPLE)
    common = rows.groupBy("anchor").agg(few.alias("hot"), F.count(F.lit(1)).alias("rows")).filter("hot")
    found = common.orderBy(F.desc("rows"), "anchor").limit(1 << 16).collect()
    return np.array(sorted(r["anchor"] for r in found), np.int64).view(np.uint64)


def _meet(segments: DataFrame) -> DataFrame:
    """One row per first of equal segments whose anchor occurs again (``whole`` false), and per repeat (true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ["anchor"]):
            key, content, times = (table.column(c).to_numpy() for c in ("anchor", "content", "times"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            passed = times == 0
            total = np.add.reduceat(times, starts)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
            whole = passed.copy()
            whole[_later(new, *(table.column(c).to_numpy() for c in ("id", "tag", "start")))] = True
            wanted = whole | (new & (total[group] > 1))
            out = table.select(["anchor", "id", "tag", "start", "n"]).append_column("whole", pa.array(whole))
            yield from out.filter(pa.array(wanted)).to_batches()

    placed = segments.repartition("anchor").sortWithinPartitions("anchor", "content", "id", "tag", "start")
    return placed.mapInArrow(run, "anchor bigint, id bigint, tag int, start int, n int, whole boolean")


def _contents(keyed: DataFrame, wanted: DataFrame, shards: int) -> DataFrame:
    """Word hashes of the wanted segments with their shard."""
    names = ["shard", "id", "tag", "start", "words"]
    each = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("cuts"))
    joined = keyed.join(each, ["id", "tag"], "left")
    text = F.when(F.col("cuts").isNotNull(), F.col("text")).alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("cuts").is_valid())
            for low, high, texts in text_parts(batch.column("text")):
                hashes, offsets = word_hashes(texts)
                cuts = batch.column("cuts").slice(low, high - low)
                row = np.repeat(np.arange(high - low), cuts.value_lengths().to_numpy(zero_copy_only=False))
                key, start, n = (c.to_numpy(zero_copy_only=False) for c in cuts.flatten().flatten())
                first = offsets[row] + start
                words = [hashes[a : a + b].tobytes() for a, b in zip(first.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((key.view(np.uint64) % np.uint64(shards)).astype(np.int32)),
                        batch.column("id").slice(low, high - low).take(pa.array(row)),
                        batch.column("tag").slice(low, high - low).take(pa.array(row)),
                        pa.array(start, pa.int32()),
                        pa.array(words, pa.binary()),
                    ],
                    names,
                )

    return joined.select("id", "tag", text, "cuts").mapInArrow(run, "shard int, id bigint, tag int, start int, words binary")


def _search(window: int):
    def search(table: pa.Table) -> pa.Table:
        """Spans of the words of a shard that are covered by a window that starts earlier."""
        doc, tag, start = (table.column(c).to_numpy() for c in ("id", "tag", "start"))
        raw = table.column("words").combine_chunks()
        values = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        index = FMIndex(values, offsets, window)
        place, lo, hi = matching_windows(index, values, offsets)
        own = np.searchsorted(offsets, place, side="right") - 1  # sequence of the window

        # Rank of every text place by (document, word), and the least one in each match interval.
        sequence = np.repeat(np.arange(len(doc)), lengths + 1)
        word = start[sequence] + _counting(lengths + 1)
        by = np.lexsort((word, tag[sequence], doc[sequence]))
        ordered = [x[by] for x in (doc[sequence], tag[sequence], word)]
        rank = np.empty(index.size + 1, np.int64)
        rank[by] = np.cumsum(np.concatenate(([0], np.any([x[1:] != x[:-1] for x in ordered], axis=0))))
        in_rows = np.append(rank[index.order], index.size)
        rows, one = np.unique(lo, return_index=True)
        least = np.minimum.reduceat(in_rows, np.stack((rows, hi[one]), axis=1).ravel())[::2]
        later = rank[place + own] > least[np.searchsorted(rows, lo)]
        own, first = own[later], (start[own] + place - offsets[own])[later]
        order = np.lexsort((first, tag[own], doc[own]))
        own, first = own[order], first[order]
        d, t, begin, end = merge_spans(doc[own], tag[own], first, first + window)
        return pa.table({"id": pa.array(d, pa.int64()), "tag": pa.array(t, pa.int32()), "begin": pa.array(begin, pa.int32()), "end": pa.array(end, pa.int32())})

    return search


def repeated_spans(keyed: DataFrame, window: int, anchor: int, hot_rows: int, shard_words: int) -> DataFrame:
    """(id, tag, spans): the words covered by a window that starts earlier, per document that has some."""
    hot = _hot_anchors(keyed, window, anchor, hot_rows)
    found = stage(_meet(_segments(keyed, hot, window, anchor)), "segments")
    words = found.filter("not whole").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    contents = _contents(keyed, found.filter("not whole"), 1 + int(words) // shard_words)
    searched = contents.groupBy("shard").applyInArrow(_search(window), "id bigint, tag int, begin int, end int")
    whole = found.filter("whole").select("id", "tag", F.col("start").alias("begin"), (F.col("start") + F.col("n")).alias("end"))
    spans = searched.unionByName(whole)
    return spans.groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    hot_rows: int = HOT_ROWS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(id, kept, n_words, n_removed, kept_sha256) per document; ``kept`` are its other words, joined by one space."""
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, window, anchor, hot_rows, shard_words)
    names = ["id", "kept", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            cuts = batch.column("spans").to_pylist()
            for text, spans in zip(text_bytes(batch.column("text")), cuts):
                words = text.split()
                left, at = [], 0
                for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
                    left += words[at : max(at, begin)]
                    at = max(at, end)
                left += words[at:]
                kept = b" ".join(left)
                out.append((kept, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest()))
            kept, n, removed, sha = zip(*out) if out else ((), (), (), ())
            id_column = pa.array([None if i == LEAST else i for i in batch.column("id").to_pylist()], pa.int64())
            columns = [id_column, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sha, pa.string())], names)

    joined = keyed.join(spans, ["id", "tag"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, "id bigint, kept string, n_words bigint, n_removed bigint, kept_sha256 string")
