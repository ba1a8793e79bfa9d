"""Words of many texts at once: Arrow batches cut to bounded size, word spans and 64-bit word hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled together up to so many bytes; a longer text is handled alone.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: One random 64-bit value for each byte, drawn once from a fixed seed.
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


#: glibc keeps what is freed in a worker that waits for its next task, unless it is told to give it back.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda kept: 0)


def give_back() -> None:
    """Return memory that nothing uses to the system: workers outlive their tasks, and many may wait beside those that run."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with at most ``limit`` bytes of text (one row at least), and their texts as bytes; null is empty."""
    texts = batch.column(column)
    if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    until = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = until[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(until, before + limit, side="right")))
        yield batch.slice(start, stop - start), [t or b"" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _until(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(16, int(n).bit_length()))


class Words:
    """Words of a list of texts: byte spans in ``data``, hashes, and the range of words of each text."""

    def __init__(self, texts: list[bytes], fold_case: bool) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if fold_case:
            data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5))
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.data, self.starts, self.ends = data, edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_ends = np.cumsum(lengths)
        self.last = np.searchsorted(self.starts, self.text_ends)
        self.first = np.concatenate(([0], self.last[:-1]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each word, whatever stands around it."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * _until(_BASE, n)[:n], out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * _until(_INVERSE, n)[self.starts]
        return mix64(own)


def shingle_sets(texts: list[bytes], words: int, fold_case: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``words`` words.

    A text with fewer words has one: its whole sequence, told apart by its length. No word, no shingle.
    """
    spans = Words(texts, fold_case)
    single = spans.hashes()
    factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, len(single) - words + 1), dtype=np.uint64)
    for k in range(words):
        runs += single[k : k + len(runs)] * factors[k]
    runs = mix64(runs + np.uint64(words))
    for first, last in zip(spans.first.tolist(), spans.last.tolist(), strict=True):
        if last - first >= words:
            yield np.unique(runs[first : last - words + 1])
        elif last > first:
            own = single[first:last]
            yield mix64(np.sum(own * factors[: len(own)], dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
        else:
            yield np.zeros(0, dtype=np.uint64)
