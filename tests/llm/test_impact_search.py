"""Ranked search against a plain sum over all documents, and the early stop against the full sum."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm import impact_search as S

from .conftest import documents

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) by the formula."""
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


def test_messy_tables_equal_the_plain_sum(spark, messy, messy_rows, empty, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    items = [(1, "The QUICK fox, the lazy dog"), (2, ""), (3, None), (4, "naïve “quoted” \U0001f600 x"), (5, "word1 token2 token2 words lines"), (6, "nowhere")]
    asked = spark.createDataFrame([*items, items[0], (None, "fox")], "item_id long, text string")
    rows = [(d, t) for d, t in messy_rows]
    assert sorted(tuple(r) for r in S.rank(messy, asked, 4).collect()) == plain(rows, items, 4)
    assert S.rank(empty, asked).count() == 0
    assert S.rank(messy, asked.limit(0)).count() == 0
    assert S.rank(documents(spark, [(1, None), (2, " . ")]), asked).count() == 0


def test_items_in_blocks_give_the_same(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 10)
    monkeypatch.setattr(S, "QUERY_BYTES", 2500)
    assert sorted(tuple(r) for r in S.rank(docs.repartition(3), items, 10).collect()) == sorted(want)


@given(st.lists(st.dictionaries(st.integers(0, 39), st.integers(1, 50), min_size=1), min_size=1, max_size=5), st.integers(1, 6), st.sets(st.integers(0, 39)))
@settings(max_examples=300, deadline=None)
def test_stopping_early_gives_the_full_sums(lists, k, hidden):
    ranked = ~np.isin(np.arange(40), list(hidden))
    terms, full = [], np.zeros(40, np.int64)
    for i, held in enumerate(lists):
        docs = sorted(held, key=lambda d: (-held[d], d))
        impacts = np.array([held[d] for d in docs], np.int64)
        groups, first = np.unique(-impacts, return_index=True)
        ends = np.append(first[1:], len(docs))
        weight = 1 + 37 * i
        terms.append((S._Postings(np.array(docs, np.int64), impacts, -groups, ends), weight))
        full[docs] += weight * impacts
    docs, scores, _ = S.best_of_block(terms, 40, ranked, k)
    order = np.lexsort((docs, -scores))[:k]
    want = sorted((-int(full[d]), d) for d in range(40) if ranked[d] and full[d] > 0)[:k]
    assert [(-int(s), int(d)) for s, d in zip(scores[order], docs[order], strict=True)] == want


def test_a_clear_winner_stops_before_the_tail():
    docs, n = np.arange(1000, dtype=np.int64), 1000
    impacts = np.sort(np.concatenate([[10**6], np.arange(999)]))[::-1].astype(np.int64)
    common = S._Postings(docs, impacts, impacts, np.arange(1, n + 1))
    got, scores, added = S.best_of_block([(common, 5)], n, np.ones(n, bool), 1)
    assert (got.tolist(), scores.tolist()) == ([0], [5 * 10**6]) and added < n
