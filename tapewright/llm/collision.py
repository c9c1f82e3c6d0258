"""Approximate nearest neighbours by collision counting on single projections.

Each of ``PROJECTIONS`` random directions gives one sorted array of all rows' projections.
A query's window on each array is centred at the query's own projection and widens from
radius to radius (virtual rehashing: the arrays stay, only the windows grow).  A row
collides on an array if it lies in the window; rows with enough collisions are verified
by their true distance.  The search ends when k verified rows are within the radius, for
then rows that near have reached the threshold with high probability, or when the radius
has come to the k-th distance that the query brings from the group it searched first.

With half-width R, a row at distance R collides with probability P(|N(0, 1)| <= 1) = 0.683
on each array; the threshold lies MARGIN standard deviations below the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .vectors import Method, search, usable

PROJECTIONS, MARGIN, GROWTH = 256, 1.2, 1.1
#: Rows of one group, about.
GROUP = 16_384
_P = 0.6826894921370859
THRESHOLD = int(np.floor(PROJECTIONS * _P - MARGIN * np.sqrt(PROJECTIONS * _P * (1 - _P))))


@lru_cache(maxsize=4)
def directions(dim: int, seed: int = 20) -> np.ndarray:
    """Normal random directions; all tasks draw the same ones."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))


class Index:
    """Sorted projections of the rows of one group."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        p = (x @ directions(x.shape[1])).T  # a row for each direction
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, 1)
        norm = np.sqrt((x**2).sum(axis=1))
        self.norm, self.scale = norm, float(np.median(norm))

    def places(self, centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of queries (rows of ``centres``) with their ``radii`` begin and end on each array: (array, query, radius)."""
        low, high = (np.empty((PROJECTIONS, *radii.shape), np.int64) for _ in range(2))
        for a in range(PROJECTIONS):
            low[a] = np.searchsorted(self.sorted[a], centres[:, a, None] - radii, "left")
            high[a] = np.searchsorted(self.sorted[a], centres[:, a, None] + radii, "right")
        return low, high

    def nearest(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, radii: np.ndarray, bound: float, k: int, not_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest found, the farthest no farther than ``bound``; rows in ``not_row`` don't count.

        ``low`` and ``high`` are the query's windows for its growing ``radii``.
        """
        hits = np.zeros(self.n, np.int64)
        hits[not_row] = -(1 << 20)
        verified = np.zeros(self.n, bool)
        rows, dist = np.empty(0, np.int64), np.empty(0)
        for t, radius in enumerate(radii.tolist()):
            if t:
                a, b, c, d = low[:, t].tolist(), low[:, t - 1].tolist(), high[:, t - 1].tolist(), high[:, t].tolist()
                rings = [o[x:y] for o, x, y in zip(self.order, a, b, strict=True)] + [o[x:y] for o, x, y in zip(self.order, c, d, strict=True)]
            else:
                rings = [o[x:y] for o, x, y in zip(self.order, low[:, 0].tolist(), high[:, 0].tolist(), strict=True)]
            hits += np.bincount(np.concatenate(rings), minlength=self.n)
            fresh = np.flatnonzero((hits >= THRESHOLD) & ~verified)
            if len(fresh):
                verified[fresh] = True
                rows = np.concatenate([rows, fresh])
                dist = np.concatenate([dist, np.sqrt(((self.x[fresh] - q) ** 2).sum(axis=1))])
            enough = min(bound, float(np.partition(dist, k - 1)[k - 1])) if len(dist) >= k else bound
            if radius >= enough:
                break
        near = dist <= bound
        return rows[near], dist[near]


def in_pair(k: int):
    def run(query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, data_ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        index = Index(x)
        # to the score to beat in two steps, or without one from small windows until all rows are in them
        first = 0.3 * np.hypot(index.scale, np.sqrt((q**2).sum(axis=1)))
        steps = int(np.ceil(np.log(1e3) / np.log(GROWTH))) + 1
        for at in range(0, len(q), 256):
            some = slice(at, at + 256)
            known = np.isfinite(bound[some])
            for which, radii in ((known, lambda i: bound[i, None] * GROWTH ** np.arange(-2.0, 1.0)), (~known, lambda i: first[i, None] * GROWTH ** np.arange(float(steps)))):
                mine = at + np.flatnonzero(which)
                for part in np.array_split(mine, -(-len(mine) // 16)) if len(mine) else ():
                    r = radii(part) + 1e-9 * index.scale  # projections of copies may differ in their last bits
                    r[:, -1] = np.where(np.isfinite(bound[part]), r[:, -1], np.inf)
                    low, high = index.places(q[part] @ directions(q.shape[1]), r)
                    for n, i in enumerate(part.tolist()):
                        rows, dist = index.nearest(q[i], low[:, n], high[:, n], r[n], float(bound[i]), k, np.flatnonzero(data_ids == query_ids[i]))
                        if len(rows):
                            best = np.lexsort((data_ids[rows], dist))[:k]
                            yield int(query_ids[i]), data_ids[rows][best], dist[best]

    return run


def reaches(q: np.ndarray, bound: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    return np.sqrt(((q - centre) ** 2).sum(axis=1)) - radius <= bound * (1 + 1e-9)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows found for each query (vec_id divisible by ``every``), by Euclidean distance.

    Returns query_id, rank, vec_id, score (the distance, in double precision on the original
    vectors): nearest first, ties to the smaller vec_id, all other rows if they are fewer.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    rows without vec_id; only vectors of one length are compared; rows that share a vec_id
    count once; other columns are not read.  An empty table gives an empty result.
    """
    return search(usable(vectors, nonzero=True), every, k, Method(in_pair, reaches, "double", False, GROUP))
