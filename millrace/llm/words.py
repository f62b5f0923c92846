"""Vectorised word hashing over Arrow string columns.

A column chunk is handled as one byte buffer: separators are found by table
lookup, and every word's 64-bit hash comes from differences of one running
polynomial sum, so the cost is a few array passes a byte and no Python work a
word.  Hashes do not depend on the process, the batch or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is one chunk of its own.
CHUNK_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
BLANKS = _separators((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of lower-cased text.
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("q", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words:
    """Words of some rows: `hashes`, byte bounds `starts` and `ends` in `data` (lower-cased), and `first[i]:first[i + 1]`, the words of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.offsets = offsets
        self.data = low = _LOWER[data]
        n = len(low)
        word = ~separators[low]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        edge[1:n] = False
        edge[offsets] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:n]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        p, q = _pow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
            raw = (total[self.ends] - total[self.starts]) * q[self.starts]
        self.hashes = mix(raw)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def bytes_of(self, row: int, a: int, b: int) -> bytes:
        """Words a to b of a row, separated by one blank."""
        k = self.first[row]
        return b" ".join(self.data[self.starts[k + j] : self.ends[k + j]].tobytes() for j in range(a, b))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of pieces of about CHUNK_BYTES; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(column: pa.Array, separators: np.ndarray = BLANKS) -> Iterator[tuple[int, Words]]:
    """(index of the first row, Words) for pieces of the column."""
    for a, _, data, offsets in chunks(column):
        yield a, Words(data, offsets, separators)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order; fewer words but some: the whole sequence as one; no words: none."""
    n = len(hashes)
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        if n < k:
            total = np.uint64(n)
            for h in hashes:
                total = mix(np.array([total * _P + h]))[0]
            return np.array([total], np.uint64)
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total = total * _P + (hashes[j : n - k + 1 + j] ^ (hashes[j : n - k + 1 + j] >> np.uint64(29)))
    return mix(total)
