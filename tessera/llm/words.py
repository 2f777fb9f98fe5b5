"""Vectorised words and hashes of Arrow text batches (numpy inside Spark tasks).

A batch is cut into chunks of about ``CHUNK`` bytes so that a worker's arrays stay small; a longer
text is a chunk of its own and is never cut. Words are byte spans; a word's hash reads eight bytes
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64

_byte = np.arange(256)
IS_SPACE = (_byte == 32) | ((_byte >= 9) & (_byte <= 13))
#: All but letters, digits and non-ASCII bytes.
IS_PUNCT = ~(((_byte >= 48) & (_byte <= 57)) | ((_byte >= 65) & (_byte <= 90)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128))
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), so that every input bit reaches every output bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive name of two named things."""
    return mix(a * U(0x9E3779B97F4A7C15) + b + U(0x632BE59BD9B4E019))


@dataclass
class Chunk:
    """Words of consecutive texts: rows first..first+n of the batch."""

    first: int
    n: int
    data: np.ndarray       # bytes, with 8 bytes of padding at the end
    bounds: np.ndarray     # n + 1 byte offsets of the texts
    start: np.ndarray      # of each word
    end: np.ndarray
    row0: np.ndarray       # n + 1: word index at which each text begins

    def counts(self) -> np.ndarray:
        return np.diff(self.row0)

    def rows(self) -> np.ndarray:
        """The text (0..n-1) of each word."""
        return np.repeat(np.arange(self.n), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end, seed)


def lanes(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every offset, little end first (data is padded)."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    left = (end - start).astype(np.int64)
    h = mix(left.astype(U) + U((seed * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
    eight, at, idx = lanes(data), start.astype(np.int64), None
    while True:
        lane = eight[at] & MASKS[np.minimum(left, 8)]
        if idx is None:
            h = mix(h ^ lane * U(0xC2B2AE3D27D4EB4F))
            idx = np.flatnonzero(left > 8)
        else:
            h[idx] = mix(h[idx] ^ lane * U(0xC2B2AE3D27D4EB4F))
            idx = idx[left > 8]
        if not len(idx):
            return h
        if len(at) != len(idx):
            keep = left > 8
            at, left = at[keep], left[keep]
        at, left = at + 8, left - 8


def chunks(column: pa.Array, separators: np.ndarray = IS_SPACE, lower: bool = False) -> Iterator[Chunk]:
    """Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and offsets[-1] > 0 else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = offsets[first], offsets[last]
        data = np.zeros(hi - lo + 8, np.uint8)
        data[:hi - lo] = LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        bounds = offsets[first:last + 1] - lo
        yield split(first, data, bounds, separators)
        first = last


def split(first: int, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Chunk:
    size = int(bounds[-1])
    inside = ~separators[data[:size]]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < size)]  # words don't run across texts
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    return Chunk(first, len(bounds) - 1, data, bounds, start, end, np.searchsorted(start, bounds))


def joined(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between them (padded), and each word's new start and end."""
    length = chunk.end - chunk.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    total = int(end[-1]) + 1 if len(end) else 0
    out = np.full(total + 8, 32, np.uint8)
    if total:
        at = np.repeat(start - chunk.start, length)
        inside = np.ones(total, bool)
        inside[end] = False
        to = np.flatnonzero(inside)
        out[to] = chunk.data[to - at]
    return out, start, end


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values in [edges[i], edges[i+1]); empty ranges give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[edges[1:]] - total[edges[:-1]]
