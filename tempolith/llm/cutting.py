"""Cutting stock by column generation, in numpy: how many sequences of each pattern of lengths to fill."""

from __future__ import annotations

import numpy as np


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern (count of each size 1..len(prices)) of greatest price within the capacity."""
    n = len(prices)
    value, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        k = min(n, c)
        gains = prices[:k] + value[c - 1 :: -1][:k]
        i = int(np.argmax(gains))
        if gains[i] > value[c - 1] + 1e-12:
            value[c], took[c] = gains[i], i + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(n, dtype=np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(value[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used in the linear program's solution.

    demand[i] pieces of size i + 1 are wanted. A revised simplex starts from one pattern a size; in each round
    the knapsack finds the column of least reduced cost for the dual prices, until none is below 0.
    """
    sizes = np.flatnonzero(demand > 0) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, len(demand)), dtype=np.int64), np.zeros(0)
    fits = capacity // sizes
    patterns = np.diag(fits)  # a column a pattern, over the sizes in demand
    inverse = np.diag(1.0 / fits)
    x = demand[sizes - 1] / fits
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.zeros(int(sizes[-1]))
        prices[sizes - 1] = np.maximum(duals, 0)
        value, full = best_pattern(prices, capacity)
        if value <= 1 + 1e-9:
            break
        column = full[sizes - 1]
        u = inverse @ column
        ok = u > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / u[ok]
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = np.maximum(x - step * u, 0)
        x[r] = step
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        patterns[:, r] = column
    out = np.zeros((m, len(demand)), dtype=np.int64)
    out[:, sizes - 1] = patterns.T
    return out, x


def whole_counts(patterns: np.ndarray, use: np.ndarray, demand: np.ndarray, unit: int, capacity: int) -> np.ndarray:
    """Integer uses of the patterns: rounded down, then by as little more as lets the rest fill all gaps.

    A piece of class i has between i * unit + 1 and (i + 1) * unit tokens. What isn't assigned goes into the
    gaps, so its least size must reach their greatest.
    """
    k = np.arange(patterns.shape[1])
    least, gap = k * unit + 1, capacity - patterns @ (k * unit + 1)

    def enough(part: float) -> tuple[bool, np.ndarray]:
        n = np.floor(use * part + 1e-7).astype(np.int64)
        rest = demand - n @ patterns
        while (rest < 0).any():  # rounding errors of the simplex
            n[np.argmax(n * (patterns[:, rest < 0] > 0).any(axis=1))] -= 1
            rest = demand - n @ patterns
        return bool(rest @ least >= n @ gap), n

    done, n = enough(1.0)
    if done:
        return n
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if enough(mid)[0] else (lo, mid)
    return enough(lo)[1]
