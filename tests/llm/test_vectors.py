import math

import numpy as np
import pytest

from tapewright.llm.collision import nearest
from tapewright.llm.cover_tree import cover_tree, in_pair, top_products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, d string, q string, rank string, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, *"abcde") for i, v in rows], SCHEMA)


def fine(v, zero=True):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def plain(rows, every, k, products):
    """Brute force over all pairs."""
    rows = [(i, np.array([np.float32(x) for x in v], np.float64)) for i, v in rows if i is not None and fine(v, products)]
    out = []
    for i, q in {i: v for i, v in rows if i % every == 0}.items():
        best = {}
        for j, x in rows:
            if j != i and len(x) == len(q):
                s = -int(np.floor(256 * q) @ np.floor(256 * x)) if products else float(np.sqrt(((q - x) ** 2).sum()))
                best[j] = min(best.get(j, s), s)
        for rank, (s, j) in enumerate(sorted((s, j) for j, s in best.items())[:k], 1):
            out.append((i, rank, j, -s if products else s))
    return out


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # copies: ties
    rows += [(2000, [0.0] * 8), (2001, None), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (None, rows[3][1]), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (2102, [])]
    return rows + [rows[7]]  # a repeated row


def test_products_equal_brute_force(spark, odd):
    got = [tuple(r) for r in top_products(frame(spark, odd), 50, 5).collect()]
    assert sorted(got) == sorted(plain(odd, 50, 5, True))


def test_products_on_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(tuple(r) for r in top_products(df, 50, 5).collect()) == sorted(plain(rows, 50, 5, True))


def test_neighbours_find_nine_in_ten(spark, small, odd):
    for df, rows in ((frame(spark, odd), odd), (df := spark.read.parquet(f"{small}/embeddings.parquet"), None)):
        rows = rows or [(r.vec_id, r.embedding) for r in df.collect()]
        got, want = nearest(df, 100, 10).collect(), plain(rows, 100, 10, False)
        assert len(got) == len(want)
        true = {(r[0], r[2]): r[3] for r in want}
        assert sum((r.query_id, r.vec_id) in true for r in got) >= 0.9 * len(want)
        by_id = dict((i, v) for i, v in rows if i is not None and fine(v, False))
        for r in got:  # distances are exact whatever is found
            q, x = (np.array(by_id[i], np.float32).astype(float) for i in (r.query_id, r.vec_id))
            assert r.score == pytest.approx(float(np.sqrt(((q - x) ** 2).sum())), rel=1e-12)
        ranks = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            assert r.rank == ranks.get(r.query_id, (0,))[0] + 1 and (r.score, r.vec_id) > ranks.get(r.query_id, (0, -1.0, -1))[1:]
            ranks[r.query_id] = (r.rank, r.score, r.vec_id)


def test_recall_on_the_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    true = {(r[0], r[2]) for r in plain(rows, 100, 10, False)}
    assert sum((r.query_id, r.vec_id) in true for r in nearest(df, 100, 10).collect()) >= 0.9 * len(true)


def test_dual_trees_prune_groups_and_stay_exact():
    """On rows in clusters most pairs are skipped; vectors without any structure leave nothing to skip."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-3000, 3000, (40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(float)
    ids, q, computed = np.arange(3000), np.arange(0, 3000, 50), []
    got = {i: list(zip(v.tolist(), s.tolist(), strict=True)) for i, v, s in in_pair(5, computed.append)(ids[q], x[q], np.full(len(q), -np.inf), ids, x)}
    for i in q.tolist():
        s = (x @ x[i]).astype(int)
        assert got[i] == [(int(j), int(s[j])) for j in np.lexsort((ids, -s)) if j != i][:5]
    assert sum(computed) < 0.5 * len(q) * len(x)


def test_no_row_is_found_twice_beside_a_large_leaf():
    """Queries so far apart that their node has no children, against rows half of which lie in a cluster."""
    rng = np.random.default_rng(6)
    x = np.floor(256 * np.concatenate([rng.normal(size=(1, 30)) + 0.05 * rng.normal(size=(150, 30)), rng.normal(size=(150, 30))]))
    ids, q = rng.permutation(300), np.arange(150, 300, 2)
    assert not cover_tree(x[q], np.arange(len(q))).children and cover_tree(x, np.arange(300)).children
    got = {i: list(zip(v.tolist(), s.tolist(), strict=True)) for i, v, s in in_pair(5)(ids[q], x[q], np.full(len(q), -np.inf), ids, x)}
    for i in q.tolist():
        s = (x @ x[i]).astype(int)
        assert got[ids[i]] == [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if j != i][:5]


def test_few_and_no_rows(spark):
    for search in (top_products, nearest):
        assert search(frame(spark, []), 50, 5).collect() == []
        assert search(frame(spark, [(0, [1.0])]), 50, 5).collect() == []
        assert [(r.query_id, r.vec_id) for r in search(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]), 50, 5).collect()] == [(0, 1)]
