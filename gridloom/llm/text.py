"""Vectorised text primitives shared by the operators: Arrow strings in, NumPy arrays out.

All work is done on UTF-8 bytes of whole texts, a few megabytes at a time, so a
Python worker's memory depends on neither the batch nor the partition, only on
the longest single text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BYTES = np.arange(256)
#: ASCII capitals to small letters, all other bytes kept.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes between white space (space and 09 to 0D).
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Word bytes that are ASCII letters or digits, or belong to a character beyond ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about ``limit`` bytes, one text at least."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, p, np.uint64)]) for p in (_P, _P_INVERSE))
    up, down = _powers
    if len(up) > 2 * CHUNK:  # tables for one very long text are not kept
        _powers = (up[:CHUNK].copy(), down[:CHUNK].copy())
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end byte of each lower-cased word, and the n + 1 word offsets of the texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    now = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(now & ~before), np.flatnonzero(now & ~after) + 1
    return hash_ranges(LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range."""
    n = len(data)
    up, down = _power_tables(max(1, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[np.minimum(starts, max(0, n - 1))] + (ends - starts).astype(np.uint64))


def shingles(h: np.ndarray, word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words, and their offsets by text; a text of fewer words has one, of all its words."""
    count = np.diff(word_offsets)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_offsets = np.r_[0, np.cumsum(many)]
    odd = [np.uint64((_P * (2 * k + 1)) % (1 << 64) | 1) for k in range(size)]
    if len(h) >= size:
        run = h[: len(h) - size + 1] * odd[0]
        for k in range(1, size):
            run = run + h[k : len(h) - size + 1 + k] * odd[k]
    else:
        run = np.zeros(0, np.uint64)
    out = np.zeros(out_offsets[-1], np.uint64)
    full = np.flatnonzero(count >= size)
    if len(full):
        at = np.repeat(word_offsets[full] - out_offsets[full], many[full]) + _within(out_offsets[full], many[full])
        out[_within(out_offsets[full], many[full])] = run[at]
    for i in np.flatnonzero((count > 0) & (count < size)):
        part = h[word_offsets[i] : word_offsets[i + 1]]
        out[out_offsets[i]] = sum((int(x) * int(o) for x, o in zip(part, odd)), len(part)) % (1 << 64)
    return mix(out), out_offsets


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + length)."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


ranges = _within


def fold(doc_ids, modulus: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo ``modulus``; a null id counts as the text ``null``."""
    return np.array([zlib.crc32(str(i if i is not None else "null").encode()) % modulus for i in doc_ids], np.int64)


def strings(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of a chunk."""
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
