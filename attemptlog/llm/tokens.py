"""Words of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words without white space (space, \t to \r), and of lower-case words, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, in place."""
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    h *= _C1
    h ^= h >> np.uint64(32)
    return h


def slices(col: pa.Array, lower: bool = True, limit: int = SLICE_BYTES, rows: int = 1 << 16
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` (at most ``rows``) of a string column with their bytes (8 zero bytes follow) and
    the rows' offsets in them.  Null texts have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        part = data[at[lo]:at[hi]]
        out = np.zeros(len(part) + 8, np.uint8)
        if lower:
            np.take(LOWER, part, out=out[:len(part)])
        else:
            out[:len(part)] = part
        yield lo, hi, out, at[lo:hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of the first word
    (one entry more than rows).  Words do not reach over rows."""
    n = int(offsets[-1])
    m = np.zeros(n + 2, bool)
    m[1:n + 1] = inside[data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(m[1:n + 1] & (~m[:n] | edge[:n]))
    ends = np.flatnonzero(m[1:n + 1] & (~m[2:n + 2] | edge[1:n + 1])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time over all words at once."""
    blocks = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    left = ends - starts
    h = left.astype(np.uint64) * _C1
    which, at = None, starts
    while len(at):
        part = blocks[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            h = mix(h ^ part)
        else:
            h[which] = mix(h[which] ^ part)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words (empty if there are fewer)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h * _C2 + words[k:m + k])
    return h
