"""Words of many texts as numbers: positions and 64-bit hashes, computed over whole Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z lower-cased. Everything works
on flat numpy arrays over a slice of rows, never per word; slices are bounded in bytes, so
memory does not depend on the number of rows in a batch (a longer text is a slice alone).
Equality of words means equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix64 = _splitmix


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return _splitmix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = stream(1, 256) | _U(1)
_BASE = 0x2545F4914F6CDD1D


class _Powers:
    """Powers of the hash's base and of its inverse, as far as asked for; they never travel with a pickled function."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def __reduce__(self) -> tuple:
        return _Powers, ()

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                up, down = np.full(size, _U(_BASE)), np.full(size, _U(pow(_BASE, -1, 1 << 64)))
                up[0] = down[0] = _U(1)
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down

    def clear(self) -> None:
        self.up = self.down = np.ones(1, _U)


_powers = _Powers()


def forget() -> None:
    """Drops the powers: an unpickled function has its own, and a worker has it in cycles of references long after its task."""
    _powers.clear()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21, most: int = 1 << 13) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most ``most`` consecutive rows with at most ``limit`` bytes of ``column``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, min(i + most, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


class Words:
    """Words of a slice, in order: ``start``, ``end`` (byte positions), ``doc`` (row), ``hash``.

    ``n`` has the words of each row, ``first`` each row's first word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        low = LOWER[data]
        letter = ~SPACE[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(data):
            start = letter.copy()
            start[1:] &= ~letter[:-1] | edge[1:-1]
            end = letter.copy()
            end[:-1] &= ~letter[1:] | edge[1:-1]
            self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.low = low
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n = np.bincount(self.doc, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        up, down = _powers(len(data))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[low] * up[: len(low)], dtype=_U)])
            h = (total[self.end] - total[self.start]) * down[self.start]
            self.hash = _splitmix(h + (self.end - self.start).astype(_U) * _U(0x9E3779B97F4A7C15))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of ``k`` consecutive words of one row, index of their first words)."""
        if len(self.hash) < k:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        c = stream(k + 2, k) | _U(1)
        m = len(self.hash) - k + 1
        with np.errstate(over="ignore"):
            g = self.hash[:m] * c[0]
            for j in range(1, k):
                g = g + self.hash[j : j + m] * c[j]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return _splitmix(g[at]), at

    def whole(self, row: int) -> int:
        """Hash of a row's whole word sequence."""
        h = self.hash[self.first[row] : self.first[row + 1]]
        with np.errstate(over="ignore"):
            return int(_splitmix(np.array([(h * stream(99, len(h))).sum(dtype=_U)]))[0])


def longs(a: np.ndarray) -> pa.Array:
    """uint64 hashes as the longs of the same bits."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))
