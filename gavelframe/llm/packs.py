"""Numpy over Arrow text columns: words hashed in whole batches, without a Python loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 1 << 21
_M = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(97).integers(1, 1 << 63, 256, dtype=np.uint64)  # one odd-looking value per byte
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWERED = _BYTES[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the offset of each row's start and of the end; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 6 << 20, most_rows: int = 10_000):
    """The batch in parts of bounded text, one row at least, so that arrays made of a part stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(upto, before + most_bytes, "right"))), at + most_rows)
        yield batch.slice(at, end - at)
        at = end


def find_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of all words; a row's end ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    cuts = off[(off > 0) & (off < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


_powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _M)]))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(_powers)) - 1, _M)]))
    return _powers


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each byte range; ranges are sorted and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    table = _LOWERED if lower else _BYTES
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SLICE)))
        s, lengths = starts[i:j], ends[i:j] - starts[i:j]
        heads = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        values = table[data[np.repeat(s, lengths) + within]] * _power(int(lengths.max()))[within]
        out[i:j] = np.add.reduceat(values, heads)
        i = j
    return splitmix(out)


def hash_words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row in order, and the offset of each row's first word and of the end."""
    data, off = text_bytes(col)
    starts, ends = find_words(data, off)
    return hash_ranges(data, starts, ends, lower), np.searchsorted(starts, off)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


_M2 = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_M2), -1, 1 << 64))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Text of each row: its kept words joined by one space."""
    s, e = starts[keep], ends[keep]
    sizes = e - s + 1
    heads = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 32, np.uint8)
    within = np.arange(len(out)) - np.repeat(heads, sizes)
    real = within < np.repeat(sizes - 1, sizes)
    out[real] = data[(np.repeat(s, sizes) + within)[real]]
    upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(keep)])[at]]
    raw = out.tobytes()
    return pa.array([raw[a: b - 1] if b > a else b"" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary()).cast(pa.string())


class Stretches:
    """Hashes of any stretches of a row of word hashes, equal exactly for equal word sequences (64 bits)."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        weight = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _M2)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * weight[:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        moved = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return splitmix(moved + np.asarray(length).astype(np.uint64) * _M)


def window_starts(off: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows of `length` words that lie inside one row."""
    sizes = np.maximum(np.diff(off) - length + 1, 0)
    return np.arange(int(sizes.sum())) + np.repeat(off[:-1] - (np.cumsum(sizes) - sizes), sizes)
