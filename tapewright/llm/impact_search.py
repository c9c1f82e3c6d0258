"""Ranked lexical search over impact-ordered postings, score at a time.

A document's share of a term's score, without the term's weight, is its impact:
``(10^9 tf) div (1000 tf + 8 m)``, with m from the document's length.  Documents are indexed in
blocks of bounded size, each by the task that reads them; within a block a term's documents
are grouped by exact impact, highest first.  So no term, however common, meets in one task.

A query goes down the impacts of all its terms in a block together and adds them up.  Once
the documents beyond the k best can't reach the k-th any more, whatever their terms still
hold, it stops and completes the scores of those k.  The blocks' best are merged by rank.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import deleted, new_path, small_batches, written

#: What a term is: fixed, as a pattern of Java and of RE2.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8 bytes: A-Z lowered, what stands between terms becomes a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and bytes of text in a block, about; bytes of the queries that are searched for in one pass.
BLOCK, BLOCK_BYTES, QUERY_BYTES = 4096, 8_000_000, 8_000_000
#: By how much the impacts looked at fall from one step to the next.
FALL = 0.6
INDEX = "block long, term string, impacts array<long>, ends array<int>, docs array<int>, ids array<long>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    n = docs.select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


class _Block:
    """Documents of one block: their terms' postings, and an Arrow batch of them."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids: list[int | None] = []
        self.m: list[int] = []
        self.terms: list[bytes] = []
        self.tf: list[int] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms_of(text)
        counts = Counter(found)
        self.ids.append(doc_id)
        self.m.append(25 + (75 * len(found) * self.n_docs) // self.n_terms if found else 0)
        self.terms += counts.keys()
        self.tf += counts.values()
        self.sizes.append(len(counts))
        self.bytes += len(text or "")

    def batch(self, number: int) -> pa.RecordBatch:
        """A row for each term, and one with the documents' ids and no term."""
        names: dict[bytes, int] = {}
        term = np.array([names.setdefault(x, len(names)) for x in self.terms], np.int64)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int64), self.sizes)
        tf = np.array(self.tf, np.int64)
        impact = 10**9 * tf // (1000 * tf + 8 * np.array(self.m, np.int64)[doc]) if len(tf) else tf
        order = np.lexsort((doc, -impact, term))
        term, doc, impact = term[order], doc[order], impact[order]
        new_term = np.flatnonzero(np.diff(term, prepend=-1))
        new_group = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(impact, prepend=-1) != 0))
        # ends of the groups, counted from their term's first posting
        owner = np.searchsorted(new_term, new_group, "right") - 1
        ends = np.append(new_group[1:], len(term)) - new_term[owner] if len(term) else new_group
        group_cuts = np.append(np.searchsorted(new_group, new_term), len(new_group))
        named = np.array([i for i, x in enumerate(self.ids) if x is not None], np.int64)
        n = len(names)
        lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), values)
        columns = [
            pa.array(np.full(n + 1, number), pa.int64()),
            pa.array([*(x.decode() for x in names), None], pa.string()),
            lists(group_cuts, pa.array(impact[new_group], pa.int64())),
            lists(group_cuts, pa.array(ends, pa.int32())),
            lists(np.append(new_term, len(term)), pa.array(np.append(doc, named), pa.int32())),
            pa.array([*[None] * n, [x or 0 for x in self.ids]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "term", "impacts", "ends", "docs", "ids"])


def index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Impact-ordered postings of ``docs`` (doc_id, text) in blocks; ``n_docs`` and ``n_terms`` as ``totals`` gives them.

    A row for each block and term: the distinct ``impacts``, highest first, ``ends`` of their
    groups in ``docs`` (places in the block).  A row without term has the block's doc_ids in
    ``ids`` and the places of documents that have one in ``docs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block(n_docs, n_terms)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(doc_id, text.as_py())
                if len(block.ids) >= BLOCK or block.bytes >= BLOCK_BYTES:
                    yield block.batch(number)
                    number, block = number + 1, _Block(n_docs, n_terms)
        if block.ids:
            yield block.batch(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


@dataclass
class _Postings:
    """A term's postings in a block: documents and impacts, highest first, and a way to a document's own."""

    docs: np.ndarray
    impacts: np.ndarray
    groups: np.ndarray
    ends: np.ndarray
    order: np.ndarray | None = None

    def of(self, docs: np.ndarray, done: int) -> np.ndarray:
        """Impacts of ``docs`` among the postings from place ``done`` on, 0 where there is none."""
        if self.order is None:
            self.order = np.argsort(self.docs)
        at = np.searchsorted(self.docs, docs, sorter=self.order)
        place = self.order[np.minimum(at, len(self.order) - 1)]
        return np.where((self.docs[place] == docs) & (place >= done), self.impacts[place], 0)


def best_of_block(terms: list[tuple[_Postings, int]], n: int, ranked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) of the k best in a block, ties at the k-th included, and how many postings were added up.

    ``terms``: postings with their weight (times repeats) in the query.  ``ranked`` says which
    of the ``n`` documents may be returned.
    """
    score = np.zeros(n, np.int64)
    at = [0] * len(terms)
    top = lambda i: terms[i][1] * int(terms[i][0].groups[at[i]]) if at[i] < len(terms[i][0].groups) else 0
    done = [0] * len(terms)
    heads = [top(i) for i in range(len(terms))]
    level = max(heads, default=0)
    while level > 0:
        level = int(level * FALL)
        for i, (p, w) in enumerate(terms):
            if heads[i] >= max(level, 1):
                # groups with w * impact at or above the level
                to = len(p.groups) - int(np.searchsorted(p.groups[::-1], -(-max(level, 1) // w)))
                until = int(p.ends[to - 1])
                score[p.docs[done[i] : until]] += w * p.impacts[done[i] : until]
                at[i], done[i] = to, until
                heads[i] = top(i)
        left = sum(heads)
        if not left:
            break
        if n > k:
            most = np.partition(np.where(ranked, score, -1), n - k - 1)
            # beyond the k best nobody can come up to the k-th
            if most[n - k - 1] + left < most[n - k :].min():
                break
        level = min(level, max(heads))
    reached = np.where(ranked, score, 0)
    kth = np.partition(reached, n - k)[n - k] if n > k else 0
    best = np.flatnonzero(reached >= max(kth, 1))
    for i, (p, w) in enumerate(terms):
        if done[i] < len(p.docs):
            score[best] += w * p.of(best, done[i])
    return best, score[best], sum(done)


def search(postings: DataFrame, items: DataFrame, n_docs: int, k: int) -> DataFrame:
    """The k best documents of an index for each item (item_id, text), in blocks of items."""
    spark = postings.sparkSession
    # rows that share an item_id are one item
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES) or 1
    found = None
    for b in range(blocks):
        mine: dict[int, Counter] = {}
        for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            mine.setdefault(r["item_id"], Counter()).update(terms_of(r["text"]))
        part = _search(postings, mine, n_docs, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(postings: DataFrame, items: dict[int, Counter], n_docs: int, k: int) -> DataFrame:
    spark = postings.sparkSession
    wanted = spark.createDataFrame([(t.decode(),) for t in {t for c in items.values() for t in c}], "term string")
    held = postings.filter("term is not null").join(F.broadcast(wanted), "term", "left_semi")  # of bounded size: QUERY_BYTES
    df = {r["term"].encode(): r["df"] for r in held.groupBy("term").agg(F.sum(F.element_at("ends", -1).cast("long")).alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    # of all terms that the corpus holds, the item's with a weight
    asked = [(item, [(t, weight[t] * n) for t, n in sorted(c.items()) if weight.get(t)]) for item, c in sorted(items.items())]
    told = spark.sparkContext.broadcast(asked)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lists, ids, ranked = {}, np.empty(0, np.int64), np.empty(0, bool)
        for term, impacts, ends, docs, of_block in zip(*(group[c] for c in ("term", "impacts", "ends", "docs", "ids")), strict=True):
            docs = np.asarray(docs, np.int64)
            if term is None:
                ids = np.asarray(of_block, np.int64)
                ranked = np.isin(np.arange(len(ids)), docs)
            else:
                impacts, ends = np.asarray(impacts, np.int64), np.asarray(ends, np.int64)
                lists[term.encode()] = _Postings(docs, np.repeat(impacts, np.diff(ends, prepend=0)), impacts, ends)
        got: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item, terms in told.value:
            mine = [(lists[t], w) for t, w in terms if t in lists]
            if mine:
                docs, scores, _ = best_of_block(mine, len(ids), ranked, k)
                order = np.lexsort((ids[docs], -scores))[:k]
                got.append((item, ids[docs][order], scores[order]))
        if not got:
            return pd.DataFrame({"item_id": [], "doc_id": [], "score": []})
        return pd.DataFrame({"item_id": np.repeat([x[0] for x in got], [len(x[1]) for x in got]), "doc_id": np.concatenate([x[1] for x in got]), "score": np.concatenate([x[2] for x in got])})

    both = held.select("block", "term", "impacts", "ends", "docs", F.lit(None).cast("array<long>").alias("ids")).unionByName(postings.filter("term is null"))
    return both.groupBy("block").applyInPandas(run, "item_id long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    A term is a longest run of letters and digits of ASCII and of characters beyond it, with
    only A-Z lowered.  With N documents that have terms, L terms in all, n in the document and
    df documents that hold the term, a term weighs w = floor(1000 ln((2N+2)/(2df+1))) and a
    document scores the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms,
    repeats included, m = 25 + (75 n N) div L.  Ties go to the smaller doc_id.

    Null and empty texts hold no terms; documents without doc_id count but aren't returned;
    each of the rows that share a doc_id is a document; rows that share an item_id are one
    item, repeated ones count once, those without item_id are left out; other columns are not
    read; without documents, items or common terms the result is empty.
    """
    spark = docs.sparkSession
    n_docs, n_terms = totals(docs)
    path = new_path(spark, "impacts")
    with small_batches(spark, 2000):
        index(docs, n_docs, n_terms).write.parquet(path)
    found = written(search(spark.read.schema(INDEX).parquet(path), items, n_docs, k), "ranked")
    deleted(spark, path)
    return found
