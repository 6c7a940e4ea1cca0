"""The median slope of all pairs of points, exactly, without forming all pairs of many points."""

from __future__ import annotations

import numpy as np

DIRECT = 1500  # points up to which all pairs are formed
FEW_PAIRS = 500_000  # so many pairs are looked at one by one in the end


def _pairs_out_of_order(p: np.ndarray, listed: bool = False):
    """How many pairs of a permutation are out of order; listed: their places instead, as two arrays. Sorted runs are merged two by two."""
    n, w, total, found = len(p), 1, 0, []
    order = np.arange(n)
    while w < n:
        i = np.arange(n)
        block, right = i // (2 * w), (i // w) % 2 == 1
        key = block * n + p[order]
        left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
        low = np.searchsorted(key[left_at], key[right_at])
        high = (block[right_at] + 1) * w
        total += int((high - low).sum())
        if listed:
            many = high - low
            ends = np.cumsum(many)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(low, many)
            found.append((order[left_at[at]], order[np.repeat(right_at, many)]))
        order = order[np.argsort(key, kind="stable")]
        w *= 2
    return tuple(np.concatenate(c) if found else np.empty(0, int) for c in zip(*found)) if listed else total


def _upto(x: np.ndarray, y: np.ndarray, t: float) -> int:
    """How many pairs with different x have a slope of at most t. x is sorted."""
    v = y - t * x
    at = np.lexsort((v, x))
    x, v = x[at], v[at]
    rank = np.empty(len(v), int)
    rank[np.lexsort((-np.arange(len(v)), v))] = np.arange(len(v))
    new = np.flatnonzero(np.r_[True, (np.diff(x) != 0) | (np.diff(v) != 0)])
    same = np.diff(np.r_[new, len(x)])
    return _pairs_out_of_order(rank) - int((same * (same - 1) // 2).sum())


def _kth(x: np.ndarray, y: np.ndarray, k: int, sample: np.ndarray, total: int) -> float:
    """The k-th least slope (from 0). Bounds from a sample of slopes are narrowed until few pairs lie between."""
    share, m = k / total, len(sample)
    spread = 4 * (share * (1 - share) / m) ** 0.5 + 2 / m
    low, high = sample[max(0, int((share - spread) * m))], sample[min(m - 1, int((share + spread) * m) + 1)]
    step = max(high - low, abs(high) * 1e-9, 1e-9)
    while (below := _upto(x, y, low)) > k:
        low, step = low - step, step * 4
    while (upto := _upto(x, y, high)) <= k:
        high, step = high + step, step * 4
    while upto - below > FEW_PAIRS:
        mid = low + (high - low) / 2
        if mid in (low, high):
            return float(high)  # all that is left is equal
        n = _upto(x, y, mid)
        low, below, high, upto = (mid, n, high, upto) if n <= k else (low, below, mid, n)
    # Pairs that change their order between the two bounds are those with a slope between them.
    order = np.lexsort((np.arange(len(x)), y - low * x))
    later = np.empty(len(x), int)
    later[np.lexsort((np.arange(len(x)), y - high * x))] = np.arange(len(x))
    a, b = _pairs_out_of_order(later[order], listed=True)
    a, b = order[a], order[b]
    dx = x[b] - x[a]
    slopes = np.sort((y[b] - y[a])[dx != 0] / dx[dx != 0])
    return float(slopes[min(max(k - below, 0), len(slopes) - 1)]) if len(slopes) else float(high)


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """The median of (y2 - y1) / (x2 - x1) over all pairs with x1 < x2; None if there is none."""
    at = np.argsort(x, kind="stable")
    x, y = x[at], y[at]
    if len(x) <= DIRECT:
        i, j = np.triu_indices(len(x), 1)
        dx = x[j] - x[i]
        keep = dx > 0
        return float(np.median((y[j] - y[i])[keep] / dx[keep])) if keep.any() else None
    same = np.unique(x, return_counts=True)[1].astype(int)
    total = len(x) * (len(x) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if total == 0:
        return None
    r = np.random.default_rng(0)
    i, j = r.integers(0, len(x), (2, 400_000))
    dx = x[j] - x[i]
    sample = np.sort((y[j] - y[i])[dx != 0] / dx[dx != 0])
    if not len(sample):
        sample = np.zeros(1)
    middle = [_kth(x, y, k, sample, total) for k in sorted({(total - 1) // 2, total // 2})]
    return float(np.mean(middle))
