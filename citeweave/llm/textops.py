"""Whole Arrow text columns as byte arrays: words, word hashes and windows without a Python loop per row.

A word is ``[^\\x20\\x09-\\x0D]+``. UTF-8 continuation bytes are never blanks, so words
can be found on bytes. Hashes have 64 bits and depend on nothing but the bytes of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_RANDOM = np.random.RandomState(20240229)
_BYTE = _RANDOM.randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW_BASE = 0xD6E8FEB86659FD93
_WINDOW_INVERSE = pow(_WINDOW_BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        size = max(count, SLICE_BYTES + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one row at least) with their bytes and offsets."""
    data, offsets = raw(column)
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


class Words(NamedTuple):
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    rows: np.ndarray  # row of each word
    first: np.ndarray  # index of the first word of each row, and the word count at the end
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """All words of the rows that ``offsets`` cut ``data`` into."""
    if lower:
        data = LOWER[data]
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(rows + 1, np.int64), np.zeros(0, np.uint64))
    solid = ~BLANK[data]
    edges = np.ones(len(data) + 1, bool)  # a word may begin: after a blank or at a row's start
    edges[1:] = ~np.append(solid, False)[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    edges[inner] = True
    starts = np.flatnonzero(solid & edges[:-1])
    closing = np.ones(len(data), bool)
    closing[:-1] = ~solid[1:]
    closing[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & closing) + 1
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(rows), np.diff(first))
    if not len(starts):
        return Words(starts, ends, owner, first, np.zeros(0, np.uint64))
    values = _BYTE[data] * powers(_BASE, len(data))
    values[~solid] = 0
    hashes = np.add.reduceat(values, starts) * powers(_INVERSE, len(data))[starts]
    return Words(starts, ends, owner, first, mix(hashes + (ends - starts).astype(np.uint64)))


def windows(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of all runs of ``size`` words inside a row."""
    count = len(found.hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    scaled = np.zeros(len(found.hashes) + 1, np.uint64)
    np.cumsum(found.hashes * powers(_WINDOW_BASE, len(found.hashes)), out=scaled[1:])
    hashes = mix((scaled[size:] - scaled[:-size]) * powers(_WINDOW_INVERSE, count) + np.uint64(size))
    starts = np.flatnonzero(found.rows[:count] == found.rows[size - 1 :])
    return starts, hashes[starts]


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring positions of ``first``; empty ranges give zero."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out = np.zeros((len(first) - 1, *values.shape[1:]), kind)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        out[filled] = np.add.reduceat(values[: first[-1]], first[filled], axis=0, dtype=kind)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start .. start+length-1 for every pair."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row boundaries."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word windows of each row over lower-cased words, sorted by row and hash, as
    (hashes, row boundaries). A row with fewer words has its whole sequence as the only one."""
    found = words(data, offsets, lower=True)
    starts, hashes = windows(found, size)
    rows = [found.rows[starts]]
    values = [hashes]
    count = np.diff(found.first)
    for short in range(1, size):
        mine = np.flatnonzero(count == short)
        if len(mine):
            at, all_hashes = windows(found, short)
            place = np.searchsorted(at, found.first[mine])
            rows.append(mine)
            values.append(all_hashes[place])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))
