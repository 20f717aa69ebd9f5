"""Texts as byte arrays inside tasks: word spans and hashes without a loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once. A single longer text makes a piece of its own.
PIECE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
# One fixed random number per byte value.
_BYTE = np.random.default_rng(20_240_607).integers(1 << 63, size=256, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``numbers[start:end]``, equal for equal runs wherever they stand."""
    sums = np.zeros(numbers.size + 1, np.uint64)
    np.cumsum(numbers * powers(_P, numbers.size), out=sums[1:])
    inverse = powers(_P_INVERSE, numbers.size + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: ``[start, end)`` in ``data``, and of text i the words
    ``first[i] .. first[i + 1]``."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        buffers = texts.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]] if len(texts) else data[:0]
        self.offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        self.data = LOWER[data] if lower else data
        self.solid = ~SPACE[self.data]
        begin, last = self.solid.copy(), self.solid.copy()
        begin[1:] &= ~self.solid[:-1]
        last[:-1] &= ~self.solid[1:]
        filled = self.offsets[:-1][np.diff(self.offsets) > 0]
        begin[filled] = self.solid[filled]
        final = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        last[final] = self.solid[final]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return run_hashes(_BYTE[self.data], self.start, self.end)

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()

    def gram_hashes(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words within one text, and of text i the runs
        ``first[i] .. first[i + 1]``."""
        counts = np.maximum(self.count - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        return run_hashes(hashes, at, at + n), first


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker stays and waits for its
    next one with what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
