"""Interpolated modified Kneser-Ney estimates over sorted key arrays."""

from __future__ import annotations

import numpy as np


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to
    4. Where those are too few for the closed form, 0.5 a count, at most 1.5."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(float(np.clip(x, 0.05, i + 0.95)) for i, x in enumerate(d))])


def count_of_counts(c: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5]


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)


def left_over(c: np.ndarray, context: np.ndarray, size: int, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, weight of the lower order) of each of ``size`` contexts."""
    total = np.bincount(context, weights=c, minlength=size)
    taken = np.bincount(context, weights=d[np.minimum(c, 3).astype(np.int64)], minlength=size)
    return total, taken / np.maximum(total, 1)


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of each ``x`` in the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x
