"""Jaro similarity as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Pairs that are compared at a time.
SLICE = 4096


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each name, filled up with zeros, and lengths."""
    n = np.array([len(x) for x in names])
    wide = max(1, n.max())
    return np.array(names, f"U{wide}").view(np.uint32).reshape(len(names), wide), n


def jaro(left: list[str], right: list[str], prefix_weight: float = 0.0) -> np.ndarray:
    """For each pair, from the letters that match within half the longer length, less half the transpositions (rounded down).

    All pairs advance together: each letter of the left names, in turn, takes the first free equal letter on the right.
    """
    if not left:
        return np.zeros(0)
    (a, na), (b, nb) = _letters(left), _letters(right)
    reach = np.maximum(0, np.maximum(na, nb) // 2 - 1)
    hit, used = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    place, widest = np.arange(b.shape[1]), int(reach.max())
    for i in range(a.shape[1]):
        low, high = max(0, i - widest), min(b.shape[1], i + widest + 1)
        if low >= high:
            break
        near = np.abs(place[low:high] - i) <= reach[:, None]
        free = (b[:, low:high] == a[:, i : i + 1]) & ~used[:, low:high] & near & (place[low:high] < nb[:, None]) & (i < na)[:, None]
        first = free.argmax(1)
        rows = np.flatnonzero(free[np.arange(len(free)), first])
        hit[rows, i] = True
        used[rows, low + first[rows]] = True
    m = hit.sum(1)
    most = int(m.max())
    # the matching letters of both sides, in order
    x, y = (np.take_along_axis(c, np.argsort(~ok, 1, kind="stable")[:, :most], 1) for c, ok in ((a, hit), (b, used)))
    swaps = ((x != y) & (np.arange(most) < m[:, None])).sum(1) // 2
    score = np.where(m > 0, (m / np.maximum(1, na) + m / np.maximum(1, nb) + (m - swaps) / np.maximum(1, m)) / 3, 0.0)
    score[np.array([x == y for x, y in zip(left, right, strict=True)])] = 1.0
    wide = min(4, a.shape[1], b.shape[1])
    start = np.cumprod((a[:, :wide] == b[:, :wide]) & (np.arange(wide) < np.minimum(na, nb)[:, None]), 1).sum(1)
    return score + start * prefix_weight * (1 - score)


@F.pandas_udf(DoubleType())
def _jaro_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.concatenate([np.zeros(0), *(1.0 - jaro(a[i : i + SLICE].tolist(), b[i : i + SLICE].tolist()) for i in range(0, len(a), SLICE))]))


#: Declared as non-deterministic, so that a filter on the result isn't planned as a second call of it.
jaro_distance = _jaro_distance.asNondeterministic()
