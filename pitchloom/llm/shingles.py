"""Words of whole Arrow columns as 64-bit hashes, and hashes of windows of words.

Words are runs of bytes other than ASCII white space (U+0009 to U+000D and the
space); in UTF-8 these bytes occur in no other character.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each text (and in all)."""
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = solid[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word, of A-Z in lower case if asked for."""
    table = _LOWER if lower else _BYTE
    size = ends - starts
    h = size.astype(np.uint64) * _C
    own = np.arange(len(starts))
    for k in range(min(48, int(size.max(initial=0)))):
        own = own[size[own] > k]
        h[own] = h[own] * _A + table[data[starts[own] + k]]
    for i in own[size[own] > 48]:
        word = table[data[starts[i] + 48 : ends[i]]]
        h[i] = h[i] * _A + (mix(word + np.arange(1, len(word) + 1, dtype=np.uint64) * _A)).sum()
    return mix(h)


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` values from each position; the last ``length - 1`` have none."""
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _A + h[k : k + n]
    return mix(out)


def slices(batch, column: int, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes in a column; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
