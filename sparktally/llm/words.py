"""Words of Arrow text columns as numpy arrays, without a Python object per word.

Texts stay UTF-8 bytes. All separators are ASCII, so a byte table tells words
from separators. A word's 64-bit hash is a difference of prefix sums over its
bytes, scaled back by the inverse power of the base, then mixed. Long texts are
hashed in pieces, so memory is bounded by the words of one slice and not by its
bytes times a factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the contracts: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but digits and letters.
NON_WORD = np.zeros(256, bool)
NON_WORD[:48] = NON_WORD[58:97] = NON_WORD[123:128] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(int(_BASE), _PIECE + 1)
_DOWN = _powers(pow(int(_BASE), -1, 2**64), _PIECE + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix64)."""
    x = x + _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` text bytes; a longer text is a slice of its own."""
    ends = offsets_of(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of the rows of a string column, one more than rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0); a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    offsets = offsets_of(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Word starts, ends (bytes), hashes, and for row i the words first[i]:first[i + 1]."""

    __slots__ = ("starts", "ends", "hashes", "first", "data")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = True):
        n = len(data)
        self.data = data = LOWER[data] if lower else data
        inside = ~separators[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        row_starts = offsets[:-1]
        before[row_starts[row_starts < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        row_ends = offsets[1:]
        after[row_ends[row_ends > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = hash_spans(self.data, self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def words_of(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = True) -> Words:
    data, offsets = text_bytes(column)
    return Words(data, offsets, separators, lower)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending, disjoint byte spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + _PIECE, "right"))
        if j <= i:  # one word longer than a piece: fold its pieces
            value = np.zeros(1, np.uint64)
            for at in range(base, int(ends[i]), _PIECE):
                part = data[at:min(at + _PIECE, int(ends[i]))]
                value = mix(value) + np.sum(_TABLE[part] * _UP[:len(part)], dtype=np.uint64, keepdims=True)
            out[i] = value[0]
            i += 1
            continue
        part = data[base:int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * _UP[:len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * _DOWN[a]
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of n consecutive words, their first per row); a shorter row that has words is one shingle.

    The number of words enters the hash of a short row, so it equals no longer shingle.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(at[-1]), np.uint64)
    if len(hashes) >= n:
        rolled = hashes[:len(hashes) - n + 1].copy()
        for j in range(1, n):
            rolled = rolled * _BASE + hashes[j:len(hashes) - n + 1 + j]
        # word index of every shingle: its row's first word plus its place in the row
        index = np.arange(int(at[-1])) + np.repeat(first[:-1] - at[:-1], sizes)
        out[:] = rolled[np.minimum(index, len(rolled) - 1)]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        value = np.uint64(int(counts[row]))
        for h in hashes[first[row]:first[row + 1]]:
            value = np.uint64((int(value) * int(_BASE) + int(h)) & (2**64 - 1))
        out[at[row]] = ~value
    return mix(out), at
