"""Vectorised text helpers that run on Arrow batches inside tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble, so that near inputs give unrelated outputs."""
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about limit bytes of the column, one row at least."""
    size = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words, and for each row the index of its first word.

    A word is a run of bytes outside 0x20 and 0x09 to 0x0D; rows never share a word."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the last."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def run_hashes(eight: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """word_hashes() of ranges of one size, 1 at least, without lower-casing, by the eights of their bytes."""
    h = np.array([size], np.uint64) * _A + _C
    for k in range(0, size, 8):
        part = eight[starts + k] if k else eight[starts]
        if size - k < 8:
            part &= U((1 << 8 * (size - k)) - 1)
        h = mix((h ^ part) * _A + U(k + 1))
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte range, after A-Z are lower-cased."""
    eight = eights(_LOWER[data] if lower else data)
    size = ends - starts
    h = size.astype(np.uint64) * _A + _C
    rest, k = np.arange(len(starts)), 0
    while len(rest):
        left = np.minimum(size[rest] - k, 8)
        part = eight[starts[rest] + k] & (~U(0) >> (U(64) - U(8) * left.astype(np.uint64)))
        h[rest] = mix((h[rest] ^ part) * _A + U(k + 1))
        k += 8
        rest = rest[size[rest] > k]
    return h


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words in each row, and each row's first; repeats are kept.

    A row of fewer words, but one at least, has its whole sequence as its only shingle."""
    n, count = len(h), np.diff(bounds)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(made)])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    row = np.repeat(np.arange(len(count)), made)
    at = bounds[:-1][row] + np.arange(to[-1]) - to[:-1][row]
    used = np.minimum(count, width)[row]
    s = mix(used.astype(np.uint64) * _C + _A)
    for k in range(width):
        w = h[np.minimum(at + k, n - 1)]
        s = np.where(k < used, mix(s * _A + w), s)
    return s, to
