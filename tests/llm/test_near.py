import re
from collections import defaultdict

import numpy as np
import pytest

from tapewright.llm import parity_join
from tapewright.llm.parity_join import Frequent, Rule, near_duplicates
from tapewright.llm.shingles import shingle_set

from .conftest import PROSE, documents


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows):
    """Set sizes and components by comparing all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    low = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in members.items()}
    return [(rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows))]


def same(df, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_messy_rows(messy, messy_rows, empty):
    same(near_duplicates(messy), messy_rows)
    assert near_duplicates(empty).collect() == []


def test_chains_of_edits(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size in (5, 6, 9, 14, 30, 60, 130):
        for _ in range(4):
            text = rng.choice(words, size).tolist()
            for _ in range(6):  # each differs a little from the one before; the first and last often by too much
                rows.append((n, " ".join(text)))
                n += 1
                text[int(rng.integers(size))] = f"x{n}"
                if rng.random() < 0.5:
                    text = text[1:] + [f"y{n}"]
    common = " ".join(f"c{i}" for i in range(40))
    rows += [(n + i, f"{common} own{i} " + " ".join(f"u{i}.{j}" for j in range(i % 20))) for i in range(60)]  # a passage that many share
    rows += [(n + 100 + i, PROSE) for i in range(50)]
    same(near_duplicates(documents(spark, rows).repartition(4)), rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Variants of one text without an original, each near to few others, in buckets of several blocks."""
    monkeypatch.setattr(parity_join, "SALTED", 5)
    monkeypatch.setattr(parity_join, "BLOCK", 400)
    rng, base = np.random.default_rng(5), [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        text, (x, y) = list(base), sorted(rng.choice(60, 2, replace=False).tolist())
        text[x], text[y] = f"p{i}", f"q{i}"
        rows.append((i, " ".join(text)))
    same(near_duplicates(documents(spark, rows).repartition(4)), rows)


@pytest.mark.parametrize("sizes", [range(1, 140), [190, 255, 256, 257, 700, 1500]])
def test_linked_sets_share_a_value(sizes):
    """The pigeonhole bound, right at the threshold: whatever values are called frequent."""
    rng, rule = np.random.default_rng(3), Rule(3, 4, 5)
    for n in sizes:
        for extra in {0, n // 7, rule.partner(n) - n}:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            m = len(a) + extra
            off = (rule.differ(len(a) + m) - extra) // 2  # so many replaced
            b = np.unique(np.concatenate([a[off:], rng.integers(0, 2**63, off + extra).astype(np.uint64)]))
            if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
                continue
            some = np.unique(np.concatenate([rule.keys(a, None), rule.keys(b, None)]))
            for told in (some[:0], some[::2], some):
                frequent = (told, np.arange(1, len(told) + 1) % 5 + 3)
                assert len(np.intersect1d(rule.keys(a, frequent), rule.keys(b, frequent)))


def test_shingles_are_the_sets():
    for text in (None, "", " \t", "A b", PROSE, PROSE.upper(), "a a a a a a a", "é É ß x y z"):
        assert len(shingle_set(text, 5)) == len(shingles(text))
    assert (shingle_set(PROSE, 5) == shingle_set(PROSE.upper(), 5)).all()


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    same(near_duplicates(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_few_and_short_join_values():
    """Sizes spread evenly over three octaves: few texts join two bands, so hardly more values than one band asks for, and they leave out two bytes."""
    rng, rule = np.random.default_rng(7), Rule(3, 4, 5)
    sizes = (512 * 2 ** (np.arange(60) / 20)).astype(int)
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    keys = [rule.keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), none) for n in sizes]
    assert sum(map(len, keys)) < 1.15 * sum(n // 3 + 1 for n in sizes)
    assert all(0 <= k.min() and k.max() < 1 << 48 for k in keys)


def test_frequent_values_are_told_apart():
    rng = np.random.default_rng(8)
    known = np.unique(rng.integers(-(2**62), 2**62, 3000))
    asked = np.concatenate([known[::7], rng.integers(-(2**62), 2**62, 5000)])
    counts = dict(zip(known.tolist(), range(1, len(known) + 1)))
    assert Frequent(known, np.arange(1, len(known) + 1)).times(asked).tolist() == [counts.get(v, 0) for v in asked.tolist()]
    assert not Frequent(known[:0], known[:0]).times(asked).any()


def test_sizes_beyond_their_bits_lose_no_link(spark):
    words = [f"z{i}" for i in range(110_000)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate((110_000, 80_000, 66_000, 51_000, 36_000))]  # the middle three link
    same(near_duplicates(documents(spark, rows).repartition(3)), rows)


def test_entries_are_two_numbers_and_a_salt(spark):
    """Values and sizes share one number, so a row is no wider than that where classes meet."""
    frame = next(parity_join._entries(Rule(3, 4, 5), Frequent(*[np.empty(0, np.int64)] * 2))(iter([parity_join.pd.DataFrame({"text": [PROSE, None, PROSE]})])))
    assert frame.columns.tolist() == ["entry", "fp", "salt"] and (frame["entry"] & 65535).unique().tolist() == [len(shingles(PROSE))]
    assert set(frame["entry"].to_numpy().view(np.uint64) >> np.uint64(16)) <= {int(v) for v in Rule(3, 4, 5).keys(shingle_set(PROSE, 5), (np.empty(0, np.int64),) * 2)}
