"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data of a pair of groups are each indexed by a cover tree: a node has a centre
and a covering radius, and its children's centres are more than half that radius apart.
A pair of nodes cannot hold a better score than
``<cq, cr> + |cq| rr + |cr| rq + rq rr``; it is left out if that is below the worst k-th
score of the query node's queries so far.  Children are bounded together in one matrix
product, promising pairs go first, and leaves hold up to ``LEAF`` points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Method, search, usable

#: Rows of one group, about, and of the smallest inner node.
GROUP, LEAF = 2048, 16
#: After so many centres in a row that cover only themselves the other points are taken for such too.
ALONE = 24
#: Products of larger bounds are computed with exact integers instead of doubles.
EXACT = 2.0**52


@dataclass
class Node:
    """Rows within ``radius`` of ``centre``: those of the children, and single ones."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)
    single: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def cover_tree(x: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree: the first child's centre is the node's own, and centres are over half the node's radius apart."""
    centre = x[rows[0]]
    dist = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
    # rounding must not shrink a covering radius
    node = Node(centre, float(dist.max()) * (1 + 1e-9), rows)
    if len(rows) <= leaf or node.radius == 0:
        node.single = rows
        return node
    rest, single, alone = rows, [], 0
    while len(rest) and alone < ALONE:
        near = dist <= node.radius / 2
        if near.sum() > 1:
            node.children.append(cover_tree(x, rest[near], leaf))
            alone = 0
        else:
            single.append(rest[near])
            alone += 1
        rest = rest[~near]
        if len(rest):
            dist = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(axis=1))
    # without children a node is a leaf, whatever its size: `in_pair` tells leaves by this identity
    node.single = np.concatenate([*single, rest]) if node.children else rows
    return node


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; those beyond 64 bits saturate."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    limit = 2**63 - 1
    return np.clip(exact(q) @ exact(x).T, -limit, limit).astype(np.int64)


class _Best:
    """The k best (score, vec_id) of each query so far, ties to the smaller vec_id."""

    def __init__(self, n: int, k: int, bound: np.ndarray):
        self.k = k
        self.score = np.full((n, k), _LOW)
        self.vec = np.full((n, k), np.iinfo(np.int64).max)
        self.bound = bound

    def least(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to count."""
        return np.maximum(self.score[rows, self.k - 1].astype(float), self.bound[rows])

    def take(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if score.shape[1] > self.k:
            kth = np.partition(score, -self.k, axis=1)[:, -self.k]
        else:
            kth = score.min(axis=1)
        at, column = np.nonzero((score >= np.maximum(kth, self.score[rows, self.k - 1])[:, None]) & (score > _LOW))
        for i in np.unique(at):
            mine = column[at == i] if len(rows) < 64 else column[np.searchsorted(at, i) : np.searchsorted(at, i, "right")]
            row = rows[i]
            s, v = np.concatenate([self.score[row], score[i, mine]]), np.concatenate([self.vec[row], ids[mine]])
            order = np.lexsort((v, ~s))[: self.k]
            self.score[row], self.vec[row] = s[order], v[order]


_LOW = np.iinfo(np.int64).min


def in_pair(k: int, count: Callable[[int], None] = lambda n: None):
    """``count`` is told how many products each comparison computes, those with centres included."""

    def run(query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, data_ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        best = _Best(len(q), k, bound)
        stack = [(np.inf, cover_tree(q, np.arange(len(q))), cover_tree(x, np.arange(len(x))))]
        while stack:
            top, a, b = stack.pop()
            # equal scores may still win by a smaller vec_id, so only worse bounds go
            if top < best.least(a.rows).min():
                continue
            if len(a.single) and len(b.single):
                s = _products(q[a.single], x[b.single])
                count(s.size)
                s[query_ids[a.single][:, None] == data_ids[b.single][None, :]] = _LOW
                best.take(a.single, s, data_ids[b.single])
            left, right = ([*n.children, *([Node(n.centre, n.radius, n.single, single=n.single)] if len(n.single) and n.children else [])] or [n] for n in (a, b))
            if not a.children and not b.children:
                continue
            ca, cb = np.stack([n.centre for n in left]), np.stack([n.centre for n in right])
            ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
            na, nb = np.sqrt((ca**2).sum(axis=1)), np.sqrt((cb**2).sum(axis=1))
            bounds = ca @ cb.T + na[:, None] * rb + ra[:, None] * nb + ra[:, None] * rb
            count(bounds.size)
            # rounding goes with the terms, however much of them cancels out
            bounds += (na + ra)[:, None] * (nb + rb) * 1e-9 + 1e-6
            least = np.array([best.least(n.rows).min() for n in left])
            pairs = [(float(bounds[i, j]), left[i], right[j]) for i, j in zip(*np.nonzero(bounds >= least[:, None]), strict=True) if left[i].rows is not a.single or right[j].rows is not b.single]
            stack += sorted(pairs, key=lambda p: p[0])
        for i, query in enumerate(query_ids.tolist()):
            got = (best.vec[i] != np.iinfo(np.int64).max) & (best.score[i] >= bound[i])
            if got.any():
                yield query, best.vec[i][got], best.score[i][got]

    return run


def reaches(q: np.ndarray, bound: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    long = np.sqrt((q**2).sum(axis=1))
    return q @ centre + long * radius + long * (np.sqrt((centre**2).sum()) + radius) * 1e-9 + 1e-6 >= bound


def top_products(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query (vec_id divisible by ``every``).

    Components are floor(256 x).  Returns query_id, rank, vec_id, score: exact, ties to the
    smaller vec_id, all other rows if they are fewer.  Vectors that are null or hold null or
    non-finite components take no part, nor do rows without vec_id; only vectors of one
    length are compared; rows that share a vec_id count once; other columns are not read.
    Products beyond 64 bits saturate, so the order among such scores is by vec_id alone.
    An empty table gives an empty result.
    """
    whole = usable(vectors).select("vec_id", F.transform("embedding", lambda v: F.floor(v * 256.0).cast("double")).alias("embedding"))
    return search(whole, every, k, Method(in_pair, reaches, "long", True, GROUP))
