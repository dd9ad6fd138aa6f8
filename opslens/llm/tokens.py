"""Vectorised reading of text columns inside tasks: UTF-8 bytes, exact codes of words, and 64-bit hashes of any slice of them.

A text column arrives as one Arrow buffer, so all texts of a batch are looked at with a few numpy passes and no
loop over characters. Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, the class `[^\\x20\\x09-\\x0D]`; all six are single bytes in UTF-8.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# odd, so it has an inverse modulo 2**64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for step in (BASE, INVERSE):
            row = np.full(size, step, dtype=np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Slices:
    """Hashes of any slice of a sequence of 64-bit symbols, each from two prefix sums.

    They are polynomials modulo 2**64, so texts can be made whose hashes agree: they deal and sort, and whoever needs equality compares bytes.
    """

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:], dtype=np.uint64)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than 2 GB stay in pieces
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, index, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(index, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most `limit` bytes together; a longer text stands alone, whole."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the machine; workers live on and serve later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """The words of some texts: byte range and hash of each, and where each text's words begin."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = ~separator[raw]
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (first[:-1] | ~before))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
        self.text_offsets = np.searchsorted(self.starts, offsets)
        self.inside = inside
        self._coded = None

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word, the same in every text. Words of these texts are told apart by their bytes, so only words of different tasks can clash."""
        codes, distinct = self.coded()
        return np.array([xxh3_64_intdigest(word, seed) for word in distinct.to_pylist()], dtype=np.uint64)[codes]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.text_offsets))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """For every word its place in the list of distinct words, and that list."""
        if self._coded is None:
            self._coded = _coded(self.raw[self.inside], self.ends - self.starts)
        return self._coded

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space behind each, whatever stood between them, and where each begins there (and where the last ends)."""
        ends = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.cumsum(self.ends - self.starts + 1, out=ends[1:])
        out = np.full(ends[-1], 0x20, dtype=np.uint8)
        letters = np.ones(ends[-1], dtype=bool)
        letters[ends[1:] - 1] = False
        out[letters] = self.raw[self.inside]
        return out, ends


def _coded(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    ends = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=ends[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    found = column.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def coded_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For each of some rising, disjoint spans its place in the list of distinct ones, told apart by their bytes, and that list."""
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return _coded(raw[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)], ends - starts)


def exact_grams(codes: np.ndarray, kinds: int, k: int) -> list[np.ndarray]:
    """Columns of numbers that agree exactly where the k codes (below `kinds`) that start there agree."""
    n = len(codes) - k + 1
    if n <= 0:
        return [np.zeros(0, dtype=np.int64)]
    bits = max(1, int(kinds).bit_length())
    each = max(1, 63 // bits)
    out = []
    for first in range(0, k, each):
        key = np.zeros(n, dtype=np.int64)
        for i in range(first, min(first + each, k)):
            key = (key << bits) | codes[i : i + n]
        out.append(key)
    return out


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols that start at each place (len - k + 1 of them)."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, width = None, 0
    power, size = symbols, 1  # power: hash of `size` symbols at each place
    rest = k
    while rest:
        if rest & 1:
            part = power[width : width + n] * _pow(width)
            total = part if total is None else total + part
            width += size
        rest >>= 1
        if rest:
            power = power[:-size] + power[size:] * _pow(size)
            size *= 2
    return mix(total)


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    return np.minimum(have[:n], have[width - size : width - size + n])
