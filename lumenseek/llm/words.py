"""Vectorised word and shingle hashing over Arrow string buffers.

Words are the runs of bytes other than U+0020 and U+0009..U+000D, compared with A-Z
lower-cased. Everything works on the UTF-8 bytes of a whole batch at once, so no Python
string is made per word; a batch is walked in pieces of about ``PIECE`` bytes, which bounds
the memory whatever the texts' lengths (a longer text is one piece of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_TABLE = np.random.default_rng(20_250_101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(cache[0]) < n:
        grown = np.full(max(n, 256), _BASE, dtype=np.uint64)
        grown[0] = 1
        cache[0] = np.multiply.accumulate(grown)
    return cache[0]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of at most ``most`` bytes each, or of one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word in order, and for each document where its words begin."""
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), at
    places = np.flatnonzero(inside)
    first = np.flatnonzero(begins[places])
    lengths = np.diff(np.append(first, len(places)))
    within = np.arange(len(places)) - np.repeat(first, lengths)
    values = _TABLE[raw[places]] * _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), at


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one document; fewer words: the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    take = min(n, k)
    out = np.full(n - take + 1, take, dtype=np.uint64)
    for j in range(take):
        out = mix(out * _BASE + words[j : n - take + 1 + j])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


_held: dict[str, dict] = {}


def held(kind: str) -> dict:
    """What a worker keeps from task to task for one kind of stage. Workers outlive stages and stand beside an executor's
    own memory, so what another kind kept is dropped."""
    for other in [k for k in _held if k != kind]:
        _held.pop(other).clear()
    return _held.setdefault(kind, {})


def tidy(stage: Callable) -> Callable:
    """A batch function that, when its task ends, gives freed memory back to the system: workers live on for
    other stages, beside an executor's own memory."""

    @wraps(stage)
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stage(stream)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run
