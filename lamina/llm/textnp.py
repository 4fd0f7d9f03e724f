"""Whole-batch text primitives in numpy, straight on Arrow's UTF-8 buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and their n + 1 offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, (_, where, data) = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Classes of bytes: 0 white space and control, 1 letters, digits and all bytes beyond ASCII, 2 other ASCII marks.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)


def tokens(column: pa.Array | pa.ChunkedArray, words_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one byte class as tokens, lower case: 64-bit hashes, lengths in bytes, and n + 1 offsets by row."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = KIND[data]
    if words_only:
        kind = np.where(kind == 1, kind, 0)
    first = np.empty(len(kind), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    value = LOWER[data]
    value *= power[place]
    hashes = np.add.reduceat(value, starts)
    keep = kind[starts] > 0
    starts, lengths, hashes = starts[keep], lengths[keep], mix(hashes[keep])
    return hashes, lengths, np.searchsorted(starts, offsets)
