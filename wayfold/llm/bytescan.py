"""Words of whole Arrow text columns as numpy arrays, without a Python object per word.

A column's UTF-8 bytes lie in one buffer; words are runs of bytes outside a set of separators, and each gets a
64-bit polynomial hash over randomised byte values. Equal words have equal hashes; two different words share one
with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_PERIOD = 1 << 16
_BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(_PERIOD, _BASE, dtype=np.uint64))


_POWER = _powers()


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """A lookup table over bytes that is True in the given inclusive spans."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    values = (values ^ (values >> np.uint64(32))) * MIX
    values = (values ^ (values >> np.uint64(29))) * MIX
    return values ^ (values >> np.uint64(32))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with about `most` bytes each; a longer row stands alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes outside `separator`, none across rows; and each row's first run (rows + 1)."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, ignored: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span. Bytes between spans must be in `ignored` or absent."""
    if len(begins) == 0:
        return np.zeros(0, dtype=np.uint64)
    value = _BYTE_VALUE if ignored is None else np.where(ignored, np.uint64(0), _BYTE_VALUE)
    low, high = int(begins[0]), int(ends[-1])
    begins = begins - low
    place = np.arange(high - low, dtype=np.int64)
    place -= np.repeat(begins, np.diff(begins, append=high - low))
    place &= _PERIOD - 1
    sums = np.add.reduceat(value[data[low:high]] * _POWER[place], begins)
    return mix(sums ^ ((ends - low - begins).astype(np.uint64) << np.uint64(48)))


def word_hashes(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words, A-Z lower-cased and split at ASCII white space, and each row's first word (rows + 1)."""
    hashes, counts = [], []
    for first, last in row_blocks(offsets, block):
        part = LOWER_ASCII[data[offsets[first] : offsets[last]]]
        begins, ends, rows = words(part, offsets[first : last + 1] - offsets[first], ASCII_SPACE)
        hashes.append(hash_spans(part, begins, ends, ASCII_SPACE))
        counts.append(np.diff(rows))
    starts = np.zeros(len(offsets), dtype=np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=starts[1:])
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), starts
