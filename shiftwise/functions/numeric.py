"""Small numeric helpers for finished, few-row results and bounded groups."""

from __future__ import annotations

import functools
import math

import numpy as np


def harmonic(n: int) -> float:
    """1 + 1/2 + ... + 1/n: the first terms added, the rest by the asymptotic series from there."""
    first = min(n, 64)
    total = float(np.sum(1.0 / np.arange(1, first + 1)))
    tail = lambda m: math.log(m) + 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4)
    return total + tail(n) - tail(first) if n else 0.0


def harmonic_squares(n: int) -> float:
    """1 + 1/4 + ... + 1/n^2, in the same way."""
    first = min(n, 64)
    total = float(np.sum(1.0 / np.arange(1, first + 1, dtype=float) ** 2))
    tail = lambda m: -1 / m + 1 / (2 * m**2) - 1 / (6 * m**3) + 1 / (30 * m**5)
    return total + tail(n) - tail(first) if n else 0.0


def scholz_stephens_g(n: int) -> float:
    """Double sum g of the k-sample Anderson-Darling variance, in closed form: H2(n) - (2 H(n-1) + 1/n) / n."""
    return harmonic_squares(n) - (2 * harmonic(n - 1) + 1 / n) / n


def anderson_darling_sigma(n1: int, n2: int) -> float:
    """Standard deviation of the two-sample statistic (Scholz and Stephens 1987)."""
    n, k = n1 + n2, 2
    if min(n1, n2) < 1 or n < 4:
        return float("nan")
    inv, h, g = 1 / n1 + 1 / n2, harmonic(n - 1), scholz_stephens_g(n)
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * inv
    b = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * inv - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * inv + 4 * h
    d = (2 * h + 6) * k**2 - 4 * h * k
    return math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1.0) * (n - 2) * (n - 3)))


def assign_min_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal one-to-one assignment by shortest augmenting paths with potentials."""
    rows, cols = cost.shape
    if rows > cols:
        return sorted((r, c) for c, r in assign_min_cost(cost.T))
    u, v = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        dist, via = np.full(cols, np.inf), np.full(cols, -1)
        done = np.zeros(cols, bool)
        row, last, reached = start, -1, 0.0
        tight_rows = [(start, 0.0)]
        while True:
            slack = reached + cost[row] - u[row] - v
            better = ~done & (slack < dist)
            dist[better], via[better] = slack[better], last
            col = int(np.argmin(np.where(done, np.inf, dist)))
            done[col], reached, last = True, dist[col], col
            if owner[col] < 0:
                break
            row = int(owner[col])
            tight_rows.append((row, reached))
        for r, at in tight_rows:
            u[r] += reached - at
        v[done] -= reached - dist[done]
        while last >= 0:
            before = via[last]
            owner[last] = start if before < 0 else owner[before]
            last = before
    return sorted((int(owner[c]), c) for c in range(cols) if owner[c] >= 0)


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Expected MI (nats) of two labelings with the given marginals, hypergeometric model."""
    return float(expected_by_sizes(a, b).sum())


def expected_by_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of every group of ``a`` in the expected MI with a labeling whose groups have the sizes ``b``.

    A part depends on the size of the group alone, so every pair of different sizes is worked out once.
    """
    (sizes, of), (others, times) = np.unique(a, return_inverse=True), np.unique(b, return_counts=True)
    n = int(np.sum(b))
    if n <= SMALL:
        terms = _small_terms(n)[np.ix_(sizes, others)]
    else:
        terms = _expected_terms(sizes, others, n)
    return (terms @ times)[of]


SMALL = 256  # rows up to which the terms of all sizes are kept


@functools.lru_cache(8)
def _log_factorials(n: int) -> np.ndarray:
    return np.array([math.lgamma(i + 1) for i in range(n + 1)])


@functools.lru_cache(8)
def _small_terms(n: int) -> np.ndarray:
    every = np.arange(n + 1)
    return _expected_terms(every, every, n)


def _expected_terms(sizes: np.ndarray, others: np.ndarray, n: int, most: int = 1_000_000) -> np.ndarray:
    """Expected MI of one group of each of the ``sizes`` with one of each of the ``others``, about ``most`` overlaps at once."""
    x, y = (v.ravel() for v in np.meshgrid(np.asarray(sizes, np.int64), np.asarray(others, np.int64), indexing="ij"))
    low = np.maximum(1, x + y - n)
    count = np.maximum(np.minimum(x, y) - low + 1, 0)
    logs, out, ends = _log_factorials(n), np.zeros(len(x)), np.cumsum(count)
    fixed = logs[x] + logs[y] + logs[n - x] + logs[n - y] - logs[n]
    start = 0
    while start < len(x):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        c = count[start:end]
        of = np.repeat(np.arange(start, end), c)
        k = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
        weight = fixed[of] - (logs[k] + logs[x[of] - k] + logs[y[of] - k] + logs[n - x[of] - y[of] + k])
        terms = k / n * (np.log(k) + math.log(n) - np.log(x[of]) - np.log(y[of])) * np.exp(weight)
        out[start:end] = np.bincount(of - start, terms, end - start)
        start = end
    return out.reshape(len(sizes), len(others))


def ks_exact_p(n1: int, n2: int, distance: float) -> float:
    """P(D >= distance) for two samples of ``n1`` and ``n2`` rows without ties.

    Orders of the joint sample are lattice paths from (0, 0) to (n1, n2); those that stay nearer than the distance to the diagonal
    are counted row by row, each row scaled so that the last number is their share of all paths.
    """
    if not n1 or not n2:
        return 1.0
    reach = round(distance * n1 * n2)
    j = np.arange(n2 + 1)
    inside = np.where(j * n1 < reach, 1.0, 0.0)
    for i in range(1, n1 + 1):
        near = np.abs(i * n2 - j * n1) < reach
        inside = np.where(near, _paths(inside, near), 0.0) * (i / (n2 + i))
    return float(min(1.0, max(0.0, 1.0 - inside[-1])))


def _paths(below: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Paths to each cell of a row: from below, or from the left inside the band, which is one stretch."""
    first = int(np.argmax(near)) if near.any() else len(near)
    out = np.zeros(len(below))
    out[first:] = np.cumsum(below[first:])
    return out
