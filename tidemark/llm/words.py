"""Words, their hashes and runs of words as numpy arrays, straight from Arrow's text buffers.

A text is cut at ASCII separators only, so bytes of UTF-8 can be classified one by one and no text is decoded.
Blocks of about a megabyte keep memory flat however many rows a batch has; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def space_table() -> np.ndarray:
    """True for bytes of words between white space: all but 0x20 and 0x09-0x0D."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alnum_table() -> np.ndarray:
    """True for digits, ASCII letters in lower case and all bytes from 0x80."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & (2**64 - 1), U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Block:
    """Words of rows lo..hi-1 of a batch."""

    lo: int
    hi: int
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of each row's text in data, one more than rows
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, one more than rows

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        up, down = powers(max(n, 1))
        total = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def blocks(column: pa.Array, table: np.ndarray, lower: bool = False, size: int = 1 << 20, rows: int = 1 << 20) -> Iterator[Block]:
    """Cut a column of texts into blocks of about ``size`` bytes and ``rows`` rows at most; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, text = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(text, np.uint8) if text is not None and text.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, len(column), lo + rows)
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if lower:
            part = lower_table()[part]
        inside = table[part]
        edge = np.zeros(len(part) + 1, bool)  # a row begins here
        edge[at] = True
        begins, ends = inside.copy(), inside.copy()
        if len(part):
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            ends[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Block(lo, hi, part, at, start, end, np.searchsorted(start, at))
        lo = hi


def slices(batch: pa.RecordBatch, columns: list[str], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of ``columns`` in a part have about ``size`` bytes; a longer row is a part of its own."""
    upto = np.zeros(batch.num_rows + 1, np.int64)
    for c in columns:
        lengths = pa.compute.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False)
        upto[1:] += np.cumsum(lengths, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i and each k below counts[i]: (i, k), in order."""
    counts = np.asarray(counts, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs(block: Block, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """The texts of runs of words, n[i] (1 at least) from word first[i] on, joined by one space."""
    which, k = spread(n)
    word = first[which] + k
    length = block.end[word] - block.start[word]
    cell, byte = spread(length + 1)
    out = block.data[np.minimum(block.start[word][cell] + byte, max(0, len(block.data) - 1))]
    out[byte == length[cell]] = 0x20
    ends = np.cumsum(np.bincount(which, length + 1, len(n))).astype(np.int64)
    out = np.delete(out, ends - 1)  # the space after a run's last word
    offsets = np.append(0, ends - np.arange(1, len(n) + 1)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.string())


def rolling(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of every m consecutive values, by doubling; shorter than h by m - 1."""
    if len(h) < m:
        return np.zeros(0, U)
    out, done, base, step, length = None, 0, 0xD1342543DE82EF95, h, 1
    bits = m
    while bits:
        if bits & 1:
            part = step[done:]
            if out is None:
                out, done = part, length
            else:
                n = min(len(out), len(part))
                out, done = out[:n] * U(pow(base, length, 1 << 64)) + part[:n], done + length
        bits >>= 1
        if bits:
            step = step[:-length] * U(pow(base, length, 1 << 64)) + step[length:]
            length *= 2
    return mix(out[: len(h) - m + 1])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    if len(v) < w:
        return v[:0]
    length = 1
    while 2 * length <= w:
        v = np.minimum(v[:-length], v[length:])
        length *= 2
    return np.minimum(v[: len(v) - (w - length)], v[w - length :]) if w > length else v


def inside_row(block: Block, m: int) -> np.ndarray:
    """Indices of words at which m consecutive words of one row begin."""
    n = int(block.first[-1])
    if n < m:
        return np.zeros(0, np.int64)
    ok = np.ones(n - m + 1, bool)
    row = block.row_of_word()
    ok &= row[: n - m + 1] == row[m - 1 :]
    return np.flatnonzero(ok)


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch of named (values, type)."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t, from_pandas=False) for v, t in columns.values()], names=list(columns))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)
