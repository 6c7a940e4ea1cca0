"""Bucket identifiers of byte strings, by bucket-pointer refinement, and the windows' anchors."""

from __future__ import annotations

import numpy as np

from .common import mix64

_r = np.random.default_rng(11)
_BYTE = _r.integers(0, 1 << 64, 256, np.uint64)
_MUL = _r.integers(0, 1 << 64, 16, np.uint64) | np.uint64(1)
PLACE_BITS = np.uint64(24)
SEGMENT = 1 << 21  # bytes looked at together


def buckets(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length the bucket identifier of the string of that length at every offset.

    A bucket of 2n bytes is named by the bucket at an offset and the bucket n bytes later; these names are used again for
    the next refinement. A length that is no power of two takes two overlapping buckets of the power below.
    """
    out: dict[int, np.ndarray] = {}
    h, n, level = _BYTE[data], 1, 0
    for length in sorted(lengths):
        while 2 * n <= length:
            h = h[: len(h) - n] * _MUL[level] + h[n:] if len(h) > n else h[:0]
            n, level = 2 * n, level + 1
        if n == length:
            out[length] = mix64(h)
        else:
            step = length - n
            out[length] = mix64(h[: len(h) - step] * _MUL[15] + h[step:]) if len(h) > step else h[:0]
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[: len(x) - n], x[n:])
        n *= 2
    return x if n == width else np.minimum(x[: len(x) - (width - n)], x[width - n :])


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, q: int):
    """The runs of windows (strings of `length` bytes inside one text) that share an anchor, which is the place of the least
    q-gram bucket of the window, the leftmost if several. starts, ends: of the texts in `data`.

    anchor bucket, extent identifier, first window, number of windows of each run; the windows' own identifiers.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), empty, empty, np.empty(0, np.uint64)
    ids = buckets(data, (q, length))
    gram, window = ids[q], ids[length]
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    best = _sliding_min((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), length - q + 1)
    place = (best & mask).astype(np.int64)
    valid = np.zeros(len(window) + 1, np.int8)
    has = ends - starts >= length
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, ends[has] - length + 1, -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(stop)
    n = last - first + 1
    extent = mix64(window[first] * _MUL[14] + mix64(window[last]) + n.astype(np.uint64))
    return gram[place[first]], extent, first, n, window
