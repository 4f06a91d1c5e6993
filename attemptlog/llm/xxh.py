"""XXH64 of many byte ranges of a buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                  0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))     # fixed values of XXH64
#: Ranges of more bytes than this are hashed one by one by the library.
LONG = 256


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rot(acc + word * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[s:e]`` for each start and end, as uint64.  Eight bytes must
    follow the last range; a step runs over all ranges that still have bytes."""
    seed = np.uint64(seed)
    left = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(left > LONG)
    raw = memoryview(data)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(raw[int(starts[k]):int(ends[k])], int(seed))
    rest = np.flatnonzero(left <= LONG)
    if not len(rest):
        return out
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    at, left = starts[rest].copy(), left[rest].copy()
    with np.errstate(over="ignore"):
        h = np.full(len(rest), seed + _P5, np.uint64)
        size = left.astype(np.uint64)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            acc = [np.full(len(wide), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            go = np.arange(len(wide))
            while len(go):
                p = at[wide[go]]
                for lane in range(4):
                    acc[lane][go] = _round(acc[lane][go], words[p + 8 * lane])
                at[wide[go]] += 32
                left[wide[go]] -= 32
                go = go[left[wide[go]] >= 32]
            x = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for lane in range(4):
                x = (x ^ _round(np.zeros(len(wide), np.uint64), acc[lane])) * _P1 + _P4
            h[wide] = x
        h += size
        for _ in range(3):                      # whole words of what is left, under 32 bytes
            go = np.flatnonzero(left >= 8)
            h[go] = _rot(h[go] ^ _round(np.zeros(len(go), np.uint64), words[at[go]]), 27) * _P1 + _P4
            at[go] += 8
            left[go] -= 8
        go = np.flatnonzero(left >= 4)
        h[go] = _rot(h[go] ^ (halves[at[go]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[go] += 4
        left[go] -= 4
        for _ in range(3):
            go = np.flatnonzero(left > 0)
            h[go] = _rot(h[go] ^ (data[at[go]].astype(np.uint64) * _P5), 11) * _P1
            at[go] += 1
            left[go] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    out[rest] = h
    return out
