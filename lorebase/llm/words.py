"""Words of many texts at once, as NumPy arrays over the bytes of an Arrow string column."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MULTIPLIER, _SEED = 0x9E3779B97F4A7C15, 0x5DEECE66D


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def _byte_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_MULTIPLIER) + _U(_SEED))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for at least n places."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        base = _MULTIPLIER | 1
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the total): words never cross texts. in_word marks the bytes of words, else those that aren't white space."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~is_space(data) if in_word is None else in_word
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]  # a text ends in a word and the next begins with one
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _power(len(data) + 1)
    running = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_table()[data] * up[: len(data)], out=running[1:])
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(_U))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive words, by first word; callers leave out runs that cross texts."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, _U)
    up, down = _power(n + 1)
    running = np.zeros(n + 1, _U)
    np.cumsum(hashes * up[:n], out=running[1:])
    return mix((running[width:] - running[:-width]) * down[: n - width + 1])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of a batch whose texts have about limit bytes, or one row: memory stays bounded whatever the texts' lengths."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    place = np.cumsum(lengths)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(place, (place[a - 1] if a else 0) + limit, "right")))
        yield batch.slice(a, b - a)
        a = b
