"""Whole-batch text work on raw UTF-8 bytes with numpy.

An Arrow string column is one byte buffer plus offsets. The operators of this
package look at that buffer directly: character classes are table lookups,
words and lines are runs between boundaries, and any substring has a 64-bit
hash from one prefix sum, so no Python code runs per word or per character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.RandomState(20240).randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = 12


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number modulo 2^64 by two small tables, whatever the
    exponents' size: those of the low bits, and of the multiples above."""

    def __init__(self, base: int):
        self.low = self._table(base, 1 << _LOW)
        self.step = pow(base, 1 << _LOW, 1 << 64)
        self.high = self._table(self.step, 1)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def _grow(self, top: int) -> None:
        if len(self.high) <= top >> _LOW:
            self.high = self._table(self.step, 2 * (top >> _LOW) + 1)

    def first(self, n: int) -> np.ndarray:
        self._grow(n)
        return np.multiply.outer(self.high[: (n >> _LOW) + 1], self.low).ravel()[:n]

    def at(self, where: np.ndarray, top: int) -> np.ndarray:
        self._grow(top)
        return self.high[where >> _LOW] * self.low[where & ((1 << _LOW) - 1)]


_UP, _DOWN = _Powers(_BASE), _Powers(_INV)


def trim() -> None:
    """Give memory that numpy and Arrow have freed back to the system; Python
    workers are used again, also by stages that need little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Texts:
    """The texts of a slice: ``data`` bytes, ``off`` n+1 offsets from 0."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        buf = column.buffers()
        off = np.frombuffer(buf[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.empty(0, np.uint8)
        self.data = raw[off[0] : off[-1]] if len(off) else raw[:0]
        self.off = off - off[0] if len(off) else np.zeros(1, np.int64)
        self.n = len(column)
        self._prefix = None

    def part(self, a: int, b: int) -> "Texts":
        """Texts a to b as a view of their own."""
        out = object.__new__(Texts)
        out.data, out.off = self.data[self.off[a] : self.off[b]], self.off[a : b + 1] - self.off[a]
        out.n, out._prefix = b - a, None
        return out

    def parts(self, limit: int | None = None) -> "Iterator[tuple[int, Texts]]":
        """Views of at most ``limit`` bytes, one text at least, with their first text."""
        start, limit = 0, limit or SLICE_BYTES
        while start < self.n:
            end = max(start + 1, int(np.searchsorted(self.off, self.off[start] + limit, side="right")) - 1)
            yield start, self.part(start, end)
            start = end

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.off)

    def prefix(self) -> np.ndarray:
        """Prefix sums behind ``hashes``; made once."""
        if self._prefix is None:
            self._prefix = prefix_sums(self.data)
        return self._prefix

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.prefix(), starts, ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of set ``flags`` (one per byte) in each text."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def runs(self, mask: np.ndarray, data_off: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``mask`` that stay within a text: starts, ends and
        the first run of each text (n+1 numbers)."""
        off = self.off if data_off is None else data_off
        if not len(mask):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if mask[0]:
            edge = np.concatenate(([0], edge))
        if mask[-1]:
            edge = np.concatenate((edge, [len(mask)]))
        starts, ends = edge[0::2], edge[1::2]
        inner = np.unique(off[1:-1])
        inner = inner[(inner > 0) & (inner < len(mask))]
        cut = inner[mask[inner] & mask[inner - 1]]
        if len(cut):
            starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        return starts, ends, np.searchsorted(starts, off)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP.first(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever
    they stand. Length enters the hash, so a span of zero bytes is distinct."""
    h = (prefix[ends] - prefix[starts]) * _DOWN.at(np.asarray(starts), len(prefix))
    return mix(h + (np.asarray(ends - starts).astype(np.uint64) << np.uint64(1)))


def class_table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of the batches with at most ``limit`` bytes of text, one row at least."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        total, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            part = batch.slice(start, end - start)
            yield part, Texts(part.column(part.schema.get_field_index(text)))
            start = end
        del batch, col
        trim()


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs at least twice."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    return member(keys, twice)


def member(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """True for each key that is in the ordered array."""
    if not len(ordered) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return ordered[at] == keys


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """True for each pair of spans, of eight bytes at least, with equal bytes.
    They are read as overlapping words of eight bytes."""
    out = np.empty(len(a), bool)
    words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,)) if len(data) >= 8 else None
    for lo in range(0, len(a), step):
        n = length[lo : lo + step]
        count = -(-n // 8)
        at = np.minimum(ranges(np.zeros(len(n), np.int64), count) * 8, np.repeat(n - 8, count))
        same = words[np.repeat(a[lo : lo + step], count) + at] == words[np.repeat(b[lo : lo + step], count) + at]
        out[lo : lo + step] = np.logical_and.reduceat(same, np.cumsum(count) - count)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``range(start, start + length)`` of all rows."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions inside any [start, end)."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def list_column(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(off, np.int32)), pa.array(values, kind))
