"""Words of whole texts as numpy arrays, for many texts at once.

A batch of texts is one byte buffer plus offsets, as Arrow holds it. Words are
maximal runs of bytes of a class; texts never share a word. A word's hash is a
polynomial over its lower-cased bytes, taken from prefix sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_A_TO_Z = np.arange(256, dtype=np.uint8)
_A_TO_Z[65:91] += 32
#: Folds A-Z only, as the operators' contracts ask.
LOWER = _A_TO_Z

#: Word bytes are digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Word bytes are all but the six ASCII blanks.
NONBLANK = np.ones(256, dtype=bool)
NONBLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed at once, and a bound of the buffers that go with them.
BLOCK = 1 << 19


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + (BLOCK >> 3))
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes; null is empty."""
    if column.null_count:
        column = column.fill_null(b"")
    if pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_binary()), np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def bounds(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by text) of the words of consecutive texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = keep[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[offsets < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[offsets > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lower-cased bytes of each span; spans are sorted by start."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + BLOCK))
        top = int(ends[lo:hi].max())
        power, inverse = _powers(top - base + 1)
        sums = np.empty(top - base + 1, np.uint64)
        sums[0] = 0
        values = LOWER[buf[base:top]].astype(np.uint64)
        values += np.uint64(1)
        values *= power[: top - base]
        np.cumsum(values, out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[b] - sums[a]) * inverse[a]
        lo = hi
    return mix(out)


def word_hash(word: bytes) -> int:
    """The hash of one word, as ``hashes`` gives it."""
    buf = np.frombuffer(word, np.uint8)
    return int(hashes(buf, np.zeros(1, np.int64), np.array([len(word)]))[0])


def words(text: bytes | None, keep: np.ndarray) -> list[bytes]:
    """The lower-cased words of one text, in order."""
    if not text:
        return []
    table = bytes(int(LOWER[i]) if keep[i] else 32 for i in range(256))
    return [w for w in text.translate(table).split(b" ") if w]
