"""Vectorised text helpers for tasks: numpy arrays over the bytes of an Arrow string column.

Words are the runs of `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Every helper takes whole
texts; batches are only cut between rows, so memory follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudorandom 64-bit constants, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def row_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[slice]:
    """Slices of rows whose texts hold about max_bytes; a longer text stands alone."""
    _, offsets = raw(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = max(start + 1, min(stop, len(column)))
        yield slice(start, stop)
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * kind().itemsize) if offsets else np.zeros(1, kind)
    at = at.astype(np.int64)
    text = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return text, at - at[0]


def lowered(text: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return text + (((text >= 65) & (text <= 90)).view(np.uint8) << 5)


def word_spans(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (n + 1)."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a step."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) + U64(0x51ED270B))
    at, own, k = np.arange(len(starts)), starts, 0
    while len(at):
        left = length[at] - 8 * k
        block = eight[own + 8 * k] & _MASKS[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ block) * U64(0xFF51AFD7ED558CCD) + U64(0x2545F4914F6CDD1D))
        k += 1
        more = left > 8
        at, own = at[more], own[more]
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and word offsets by row (n + 1)."""
    text, offsets = raw(column)
    text = lowered(text)
    starts, ends, by_row = word_spans(text, offsets)
    return hash_spans(text, starts, ends), by_row


def shingles(word: np.ndarray, by_row: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles by row, in order and with repeats; a row of fewer words has its whole sequence as one."""
    n = np.diff(by_row)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(bounds[-1], np.uint64)
    weights = constants(k, 77) | U64(1)
    if len(word) >= k:
        row = np.repeat(np.arange(len(n)), n)
        rolled = np.zeros(len(word) - k + 1, np.uint64)
        for i in range(k):
            rolled += word[i : len(word) - k + 1 + i] * weights[i]
        out[np.repeat(n >= k, count)] = mix(rolled[row[: len(word) - k + 1] == row[k - 1 :]])
    for i in np.flatnonzero((n > 0) & (n < k)):
        value = U64(int(n[i]))
        for w in word[by_row[i] : by_row[i + 1]]:
            value = mix(np.array([value ^ w], np.uint64) * U64(0x9E3779B97F4A7C15))[0]
        out[bounds[i]] = value
    return out, bounds


def signed(x: np.ndarray) -> pa.Array:
    """64-bit values as Spark's long."""
    return pa.array(x.view(np.int64))
