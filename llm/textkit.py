"""Vectorised word scanning and hashing over Arrow string batches.

All functions work on the UTF-8 bytes of a batch at once with numpy, so that a
Spark task spends a few array passes on a batch instead of a Python step per
word. A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which are
single bytes in UTF-8, so byte positions cut whole characters.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one numpy pass; longer single texts go alone.
SLICE_BYTES = 1 << 19

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls while small."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that hands freed memory back to the system when it ends, as its worker may go on to serve other operators.

    Arrow's buffers come from the system's allocator, as its own pool reserves memory by the gigabyte.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: spreads every input bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts hold about ``limit`` bytes together."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, len(col))
        lo = hi


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts end to end, and the texts' offsets in them (null: empty)."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of the first word of each text (and the total)."""
    solid = ~_SPACE[data]
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (with ``lower``, of its bytes with A-Z in lower case)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of each run of ``width`` words inside one text, and its first word's index.

    ``hashes`` are the words' hashes and ``first`` the texts' first words as
    :func:`words` gives them. The rolling sum is a prefix sum of word times power;
    a window is a difference of two sums, shifted back to the window's start.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    up, down = _powers(_WORD_BASE, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    at = np.arange(n - width + 1)
    text = np.searchsorted(first, at, side="right") - 1
    at = at[at + width <= first[text + 1]]
    return mix((total[at + width] - total[at]) * down[at]), at


def stretch_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of each stretch of words ``begin`` to ``end``, its length included."""
    up, down = _powers(_WORD_BASE, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix(mix((total[end] - total[begin]) * down[begin]) + (end - begin).astype(np.uint64))
