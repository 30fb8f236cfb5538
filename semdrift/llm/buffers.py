"""Arrow text columns as byte buffers, cut into pieces of bounded size, and their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False

#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of at most ``limit`` bytes, or one longer row.

    A null row has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    if column.null_count:
        column = pa.compute.fill_null(column, b"")
        _, where, data = column.buffers()
        offsets = np.frombuffer(where, dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the words of already lower-cased rows; no word spans two rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    mask = inside[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    edges = offsets[:-1][(offsets[:-1] < len(data))]
    first[edges] = mask[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    last[edges] = mask[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for name, base in (("up", int(_BASE)), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans come in order and do not overlap.

    Worked off in runs of spans of bounded size, whatever the size of ``data``.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, side="right")))
        low = starts[at]
        part = data[low:ends[to - 1]]
        s, e = starts[at:to] - low, ends[at:to] - low
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        value = part.astype(np.uint64)
        value += np.uint64(1)
        value *= up[:-1]
        np.cumsum(value, out=sums[1:])
        out[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span as an Arrow binary array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[at].tobytes())]
    )
