"""Lloyd's rounds against plain ones in whole numbers; pruning against all distances."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm import dual_lloyd as L

SCHEMA = "vec_id long, embedding array<float>, v string, cluster string, distance string, ids string"


def plain(rows, k, rounds, dim):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) by the definition."""
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for _, v in sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in ok)[:k]]
    of = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        mine = [of(v)[1] for _, v in ok]
        for j in set(mine):
            some = [v for (_, v), m in zip(ok, mine, strict=True) if m == j]
            c[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    last = [of(v) for _, v in ok]
    total = {j: sum(d for d, m in last if m == j) for j in range(len(c))}
    return sorted((i, m, d, total[m], sum(total.values()), hashlib.sha256(",".join(map(str, c[m])).encode()).hexdigest()) for (i, _), (d, m) in zip(ok, last, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def test_messy_vectors_equal_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [rows[0], rows[0], (3, rows[5][1]), (100, None), (101, [1.0]), (102, [None] * 6), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (None, rows[1][1]), (105, [0.0] * 6), (106, [])]
    monkeypatch.setattr(L, "GROUP", 25)
    got = L.lloyd(vectors(spark, rows).repartition(3), 5, 4, components=6)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, 4, 6)
    few = rows[:3]
    assert sorted(tuple(r) for r in L.lloyd(vectors(spark, few), 8, 3, components=6).collect()) == plain(few, 8, 3, 6)
    same = [(i, [0.5] * 6) for i in range(40)]
    assert sorted(tuple(r) for r in L.lloyd(vectors(spark, same), 4, 2, components=6).collect()) == plain(same, 4, 2, 6)
    empty = L.lloyd(vectors(spark, rows).limit(0), 5, 4, components=6)
    assert empty.count() == 0 and empty.columns == got.columns


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        L.lloyd(vectors(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])]), 1, 1, components=2)


@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 200), st.integers(1, 5), st.sampled_from([3, 40, 10**6]))
@settings(max_examples=150, deadline=None)
def test_pairs_of_nodes_lose_no_nearest_centroid(seed, k, n, dim, width):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-width, width, (n, dim)), rng.integers(-width, width, (k, dim))
    tree, over = L.tree_of(x), L.tree_of(c, alone=True)
    x = x[tree.order]
    tree.order = np.arange(n)
    want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (L.nearest(x, tree, c, over) == want).all()


def test_clustered_vectors_are_settled_by_nodes():
    rng = np.random.default_rng(2)
    middles = rng.integers(-9000, 9000, (40, 16))
    x = np.concatenate([m + rng.integers(-60, 60, (80, 16)) for m in middles])
    tree, over = L.tree_of(x), L.tree_of(middles, alone=True)
    x, computed = x[tree.order], []
    tree.order = np.arange(len(x))
    assert (L.nearest(x, tree, middles, over, computed.append) == ((x[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(computed) < x.shape[0] * 40 / 4
    assert (over.kids != over.kids_end).sum() > 1 and (tree.kids != tree.kids_end).sum() > 1
