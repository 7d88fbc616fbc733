"""Sorting of all strings of one length in a set of contexts, in memory."""

from __future__ import annotations

import numpy as np


def classes(x: np.ndarray) -> np.ndarray:
    """Equal values get equal numbers, from 0."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def string_minima(contexts: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    """For each context and each start in it, the least owner among all equal strings of ``length`` symbols at that start.

    All strings of a context hold its core, the columns that every start covers. From there classes of equal strings
    grow a column to the left or right at a time, so that only integers are sorted, for one start at once.
    """
    n, width = contexts.shape
    starts = width - length + 1
    out = np.empty((n, starts), np.int64)
    order = np.argsort(owners, kind="stable")
    contexts, least = contexts[order], owners[order]
    left = np.empty((starts, n), np.int32)
    left[-1] = classes(np.ascontiguousarray(contexts[:, starts - 1 : length]).view(f"V{length - starts + 1}").ravel())
    for s in range(starts - 2, -1, -1):
        left[s] = classes(left[s + 1].astype(np.int64) << 8 | contexts[:, s])
    right = np.zeros(n, np.int64)
    for s in range(starts):
        _, first, where = np.unique(left[s].astype(np.int64) << 32 | right, return_index=True, return_inverse=True)
        out[order, s] = least[first][where]  # owners ascend, so a class's first is its least
        if s < starts - 1:
            right = classes(right << 8 | contexts[:, length + s])
    return out
