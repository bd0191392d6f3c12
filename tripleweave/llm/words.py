"""Words of whole Arrow columns, cut by byte classes in numpy, with exact numbers and 64-bit hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tripleweave.llm.common import slices

#: An odd multiplier and the seed of the byte values of the polynomial word hash; any would do.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def byte_class(chars: bytes) -> np.ndarray:
    """A table of 256 flags that are set for ``chars``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


#: Space and the controls 9 to 13.
BLANK = byte_class(b" \t\n\x0b\x0c\r")


def give_back() -> None:
    """Return freed memory to the system: Python workers are used again, and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """:func:`slices`, giving back what the last one took before the next."""
    for part in slices(batches, text, limit):
        yield part
        give_back()


@dataclass
class Words:
    """Words of a column in order: row, byte span in ``data``, number in ``values`` and the distinct words."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ids: np.ndarray
    values: pa.Array


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, null as empty, and where each row begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def cut_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes whose ``inside`` flag is set; no run crosses a row."""
    n = len(data)
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = True, True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    body = pa.py_buffer(np.ascontiguousarray(data[inside]))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), body])
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(data, row, start, end, ids, coded.dictionary)


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: the run of each element and its place inside."""
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hash_values(values: pa.Array) -> np.ndarray:
    """One 64-bit hash per distinct word, the same in every task."""
    data, offsets = text_bytes(values)
    if not len(values):
        return np.zeros(0, np.uint64)
    lengths = np.diff(offsets)
    _, place = spans(lengths)
    powers = np.ones(int(lengths.max()) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, FACTOR), out=powers[1:])
    parts = np.append(_BYTES[data] * powers[place], np.uint64(0))
    sums = np.add.reduceat(parts, np.minimum(offsets[:-1], len(parts) - 1))
    sums[lengths == 0] = 0
    return mix(sums + lengths.astype(np.uint64))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of ``size`` consecutive entries for every start, by doubling."""
    out, width, powers = None, 0, h
    step, factor, left = 1, np.full(1, FACTOR), size  # arrays wrap around silently
    while left:
        if left & 1:
            if out is None:
                out, width = powers, step
            else:
                n = len(powers) - width
                out = out[: max(n, 0)] * factor + powers[width:] if n > 0 else out[:0]
                width += step
        left >>= 1
        if left:
            n = len(powers) - step
            powers = powers[: max(n, 0)] * factor + powers[step:] if n > 0 else powers[:0]
            step, factor = step * 2, factor * factor
    return out


def member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class BitTable:
    """A set of 64-bit hashes that may say yes too often; its size has a fixed bound of ``2 ** MOST`` bits (32 MB)."""

    MOST = 28

    def __init__(self, expected: int):
        self.bits = min(self.MOST, max(16, int(expected * 16).bit_length()))
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit of each hash."""
        at = mix(hashes) >> np.uint64(64 - self.bits)
        return at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        byte, bit = self.place(hashes)
        np.bitwise_or.at(self.table, byte, bit)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        byte, bit = self.place(hashes)
        return (self.table[byte] & bit) > 0


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of ``size`` consecutive entries for every start, by doubling."""
    step = 1
    while step * 2 <= size:
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        step *= 2
    rest = size - step
    if rest:
        values = np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]
    return values
