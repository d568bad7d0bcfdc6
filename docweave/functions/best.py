"""Best rows per query over the batches of one task, in numpy."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# tasks receive this class inside the job, so no worker has to install this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Best:
    """Best ``k`` rows of each of ``n`` queries by rounded goodness, ties by id."""

    def __init__(self, n: int, k: int, decimals: int):
        self.k, self.decimals = k, decimals
        self.least = np.full(n, -np.inf)
        self.rows: tuple[np.ndarray, ...] | None = None

    def bar(self, good: np.ndarray, slack: float) -> np.ndarray:
        """What a row of ``good`` (queries by rows) must reach to be among the best, with room for errors of ``slack``."""
        bar, n = self.least - slack, good.shape[1]
        if n > self.k and not np.isfinite(bar).all():
            bar = np.maximum(bar, np.partition(good, n - self.k, axis=1)[:, n - self.k] - slack)
        return bar

    def add(self, q: np.ndarray, good: np.ndarray, ids: np.ndarray, *others: np.ndarray) -> None:
        """Take rows in; their columns leave in the same order, ``good`` rounded."""
        good = np.round(good, self.decimals)
        near = good >= self.least[q]
        new = tuple(a[near] for a in (q, good, ids, *others))
        rows = new if self.rows is None else tuple(np.concatenate(p) for p in zip(self.rows, new))
        q, good, ids = rows[:3]
        by_id = np.unique(ids, return_inverse=True)[1] if ids.dtype.kind in "UO" else ids
        order = np.lexsort((by_id, -good, q))
        q = q[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.array([], int)
        position = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        self.rows = tuple(a[order[position < self.k]] for a in rows)
        last = order[position == self.k - 1]
        self.least[rows[0][last]] = good[last]
