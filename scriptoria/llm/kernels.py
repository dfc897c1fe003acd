"""Vectorised text kernels on Arrow string columns: words, word hashes, n-gram hashes.

Everything here works on the UTF-8 bytes of many documents at once. Hashes
depend on nothing but the words, so they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
WORD_BASE = np.uint64(0xD1342543DE82EF95)
#: Between words: space and the bytes 9 to 13.
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES), base, np.uint64)
        have[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(have)
    return have[:n]


def give_back() -> None:
    """Return what this process has freed to the system: a Python worker lives on between tasks, beside its executor."""
    for kind in [k for k, x in _POWERS.items() if len(x) > 2 * SLICE_BYTES]:
        del _POWERS[kind]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library; others do without
    if trim is not None:
        trim(0)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, giving back freed memory after each batch it returns and when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in work(batches):
                yield out
                del out
                give_back()
        finally:
            give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of a slice: byte ranges [start, end), the first word of each document, 64-bit hashes."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, gap: np.ndarray = GAP):
        self.raw, self.off = raw, off
        word = ~gap[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        before = np.empty(len(raw), bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(len(raw), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.per_doc = np.diff(self.first)

    def hashes(self, *prefixes: int) -> np.ndarray | list[np.ndarray]:
        """Hash of each word; with ``prefixes``, a list of the hashes of so many first bytes of each."""
        total = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.raw] * powers("p", BASE, len(self.raw)), out=total[1:])
        back = powers("i", INVERSE, len(self.raw) + 1)[self.start]
        ends = [np.minimum(self.end, self.start + n) for n in prefixes] or [self.end]
        out = [mix((total[e] - total[self.start]) * back + (e - self.start).astype(np.uint64)) for e in ends]
        return out if prefixes else out[0]

    def left(self) -> np.ndarray:
        """How many words of its document begin at each word, itself included."""
        return np.repeat(self.first[1:], self.per_doc) - np.arange(len(self.start))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, before mix(); where fewer are left, garbage."""

    def run(m: int) -> np.ndarray:
        if m == 1:
            return h.copy()
        half = run(m // 2)
        k = m // 2
        out = half * np.uint64(pow(int(WORD_BASE), k, 2**64))
        out[: len(out) - k] += half[k:]
        if m % 2:
            out *= WORD_BASE
            out[: len(out) - 2 * k] += h[2 * k :]
        return out

    return run(n) if len(h) else h.copy()
