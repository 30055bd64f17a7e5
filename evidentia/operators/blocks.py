"""Many queries against many rows in blocks: what numpy does with a block of scores inside a task of Spark's."""

from __future__ import annotations

import numpy as np

from ..session import ship


def rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds; scores are not negative."""
    return np.floor(scores * 10.0**digits + 0.5) / 10.0**digits


class Best:
    """The best limit rows of each query of a block, by rounded score and then by the smallest id; scores that round to 0 or
    less do not count. Fed with scores of some rows at a time, it holds no more than limit rows a query in between."""

    def __init__(self, queries: int, limit: int, digits: int):
        self.limit, self.digits, self.step = limit, digits, 10.0**-digits
        self.floor = np.zeros(queries)  # no score below this one can come in
        self.query, self.score, self.id = np.empty(0, np.int64), np.empty(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores has a row for each query and a column for each id."""
        floor = self.floor
        if len(ids) > self.limit and (open_ := np.nonzero(floor <= 0)[0]).size:
            nth = np.partition(scores[open_], len(ids) - self.limit, axis=1)[:, len(ids) - self.limit]
            floor = floor.copy()
            floor[open_] = np.maximum(floor[open_], nth - self.step)
        q, k = np.nonzero(scores >= np.maximum(floor, self.step / 4)[:, None])
        score = rounded(scores[q, k], self.digits)
        some = score > 0
        if not some.any():
            return
        q, score, ids = q[some], score[some], ids[k[some]]
        if self.id is not None:
            q, score, ids = np.concatenate([self.query, q]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, q))
        q = q[order]
        first = np.searchsorted(q, q)  # where each one's query begins
        order = order[np.arange(len(q)) - first < self.limit]
        q, score, ids = q[np.arange(len(q)) - first < self.limit], score[order], ids[order]
        self.query, self.score, self.id = q, score, ids
        ends = np.nonzero(np.append(q[1:] != q[:-1], True))[0]
        full = ends[np.bincount(q, minlength=len(self.floor))[q[ends]] >= self.limit]
        self.floor[q[full]] = score[full] - self.step


ship(__name__)
