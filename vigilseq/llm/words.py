"""Hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vigilseq.llm.common import text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be undone
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0
SLICE_BYTES = 1 << 19  # text hashed at once, or one document


class Powers:
    """Powers of a fixed odd number and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64)))) for base in (_BASE, inverse)
            )
        return self.up[:n], self.down[:n]


POWERS = Powers()


def text_parts(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about ``limit`` bytes with their texts; null is empty."""
    data = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, i, text_bytes(data.slice(start, i - start))
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes), text_bytes(data.slice(start))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and where each text starts among them (one entry more than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    offsets = np.concatenate(([0], np.searchsorted(first, ends)))
    if not len(first):
        return np.zeros(0, np.uint64), offsets
    up, down = POWERS.get(len(data))
    hashes = np.add.reduceat(_BYTE[data] * up, first) * down[first]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    return hashes, offsets


def run_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """64-bit hash of the words from each start on, by differences of one running sum."""
    up, down = POWERS.get(len(hashes) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[:-1])))
    found = (total[starts + lengths] - total[starts]) * down[starts]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(32)
    return found
