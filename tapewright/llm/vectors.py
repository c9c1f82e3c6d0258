"""Stated queries against all vectors, in groups of bounded size around pivots.

Rows are dealt to the nearest of some pivots, one for every ``CELL`` rows up to a bounded
number, and the rows of a pivot by hash to groups of bounded size.  Each query first searches
one group of the nearest cell that has many rows; with the k-th score found there it then
goes to the groups of those pivots alone whose centre and radius allow a better one.  A
group's rows come to a task before its queries, which pass by in blocks: no row is copied,
and a task holds one group and one block.  Each query's best rows are merged by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, written

#: Queries in a block; rows of a cell, about; pivots at most (a bounded sample by hash; every row is dealt).
QUERY_GROUP, CELL, PIVOTS = 8192, 2048, 256
#: A cell can give the first k scores if it has so many times k rows (or is the largest).
MANY = 64


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows whose vectors can be searched.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do
    zero vectors if ``nonzero``; neither do rows without a vec_id.
    """
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.filter(F.exists("embedding", lambda v: v != 0)) if nonzero else rows


@dataclass(frozen=True)
class Method:
    """How a group is searched: ``in_pair(k)`` takes query ids, queries, the scores to beat, data ids and data, and yields
    (query id, ids, scores) of rows at least that good, k at most; ``reaches`` says whether rows within a radius of a centre can be."""

    in_pair: Callable[[int], Callable[..., Iterator[tuple[int, np.ndarray, np.ndarray]]]]
    reaches: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    kind: str
    largest: bool
    group: int


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the nearest pivot of their length and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim, some in batch.groupby("dim"):
                p, x = pivots.get(int(dim)), np.stack(some["embedding"])
                if p is None or not dim:  # no pivot is that long: one cell around 0
                    far[some.index] = np.sqrt((x**2).sum(axis=1))
                    continue
                d = (x**2).sum(axis=1)[:, None] - 2 * x @ p.T + (p**2).sum(axis=1)
                cell[some.index] = d.argmin(axis=1)
                far[some.index] = np.sqrt(((x - p[cell[some.index]]) ** 2).sum(axis=1))
            yield batch.assign(cell=cell, far=far)

    return rows.mapInPandas(run, "vec_id long, embedding array<double>, dim int, h long, cell int, far double")


def search(rows: DataFrame, every: int, k: int, method: Method) -> DataFrame:
    """The ``k`` best rows for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    Only vectors of one length are compared.  Rows that share a vec_id count once, with the
    best of their scores: repeated rows go first, and a group that holds a vec_id up to m
    times gives its ``k * m`` best rows.
    """
    spark = rows.sparkSession
    pivot_count = min(PIVOTS, max(1, rows.count() // CELL))
    rows = rows.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding")).withColumn("h", F.xxhash64("vec_id", "embedding"))
    sample: dict[int, list] = {}
    for r in rows.orderBy("h").limit(pivot_count).collect():
        sample.setdefault(r["dim"], []).append(r["embedding"])
    pivots = {dim: np.array(x) for dim, x in sample.items()}
    dealt = written(_dealt(rows, pivots), "vectors")
    # a row for each pivot and length of vectors
    stats = dealt.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cells: dict[int, list[tuple[int, int, float, np.ndarray, int]]] = {}
    for r in stats.collect():
        own = pivots.get(r["dim"])
        centre = own[r["cell"]] if own is not None and r["dim"] else np.zeros(r["dim"])
        cells.setdefault(r["dim"], []).append((r["cell"], max(1, -(-r["n"] // method.group)), r["radius"] * (1 + 1e-9), centre, r["n"]))
    # homes of queries: cells with many rows, so that every query gets a k-th score there
    enough = {dim: min(MANY * k, max(c[4] for c in some)) for dim, some in cells.items()}
    homes = {dim: [c for c in some if c[4] >= enough[dim]] for dim, some in cells.items()}
    groups = spark.createDataFrame([(dim, c[0], c[1]) for dim, some in cells.items() for c in some], "dim int, cell int, groups int")
    data = dealt.drop("far").join(F.broadcast(groups), ["dim", "cell"]).select("vec_id", "embedding", "dim", "cell", F.pmod("h", "groups").cast("int").alias("part"))
    names = spark.createDataFrame([(dim, i, c[0], c[1]) for dim, some in homes.items() for i, c in enumerate(some)], "dim int, nearest int, cell int, groups int")
    asked = _dealt(dealt.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding", "dim", "h"), {dim: np.stack([c[3] for c in some]) for dim, some in homes.items()})
    asked = asked.withColumnRenamed("cell", "nearest").join(F.broadcast(names), ["dim", "nearest"]).select("vec_id", "embedding", "dim", "cell", F.pmod(F.shiftright("h", 20), "groups").cast("int").alias("part"))
    worst = -np.inf if method.largest else np.inf
    key = ["dim", "cell", "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups one after the other, each with its rows first, then its queries."""
        at: tuple | None = None
        held: list[pd.DataFrame] = []
        queries: list[pd.DataFrame] = []

        def answers() -> Iterator[pd.DataFrame]:
            if held and queries:
                d, q = pd.concat(held).sort_values("vec_id"), pd.concat(queries).sort_values("vec_id")
                held[:], m = [d], int(d["vec_id"].value_counts().max())
                out = list(method.in_pair(k * m)(q["vec_id"].to_numpy(), np.stack(q["embedding"]), q["bound"].to_numpy(float), d["vec_id"].to_numpy(), np.stack(d["embedding"])))
                if out:
                    ids, found, scores = zip(*out, strict=True)
                    yield pd.DataFrame({"query_id": np.repeat(ids, [len(x) for x in found]), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})
            queries.clear()

        for batch in batches:
            begins = (batch[[*key, "asks"]] != batch[[*key, "asks"]].shift()).any(axis=1).cumsum()
            for _, some in batch.groupby(begins.to_numpy(), sort=False):
                who = tuple(some[key].iloc[0])
                if who != at:
                    yield from answers()
                    at = who
                    held.clear()
                (queries if some["asks"].iloc[0] else held).append(some[["vec_id", "embedding", "bound"]])
                if sum(map(len, queries)) >= QUERY_GROUP:
                    yield from answers()
        yield from answers()

    def searched(queries: DataFrame) -> DataFrame:
        columns = [*key, "asks", "vec_id", "embedding", "bound"]
        both = data.withColumn("asks", F.lit(0)).withColumn("bound", F.lit(None).cast("double")).select(*columns).union(queries.withColumn("asks", F.lit(1)).select(*columns))
        return both.repartition(*key).sortWithinPartitions(*key, "asks").mapInPandas(run, f"query_id long, vec_id long, score {method.kind}")

    best = F.max("score") if method.largest else F.min("score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if method.largest else F.asc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id", "vec_id").agg(best.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    at_home = written(searched(asked.withColumn("bound", F.lit(worst))), "vectors-home")
    bounds = ranked(at_home).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound"))
    told = spark.sparkContext.broadcast(cells)

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby("dim"):
                q, bound = np.stack(some["embedding"]), some["bound"].to_numpy(float)
                own, part = some["cell"].to_numpy(), some["part"].to_numpy()
                for cell, n, radius, centre, _ in told.value[int(dim)]:
                    near = method.reaches(q, bound, centre, radius)
                    for g in range(n):
                        go = near & ~((own == cell) & (part == g))
                        if go.any():
                            yield some[go].assign(cell=np.int32(cell), part=np.int32(g))

    rest = asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(worst)))
    rest = rest.select("vec_id", "embedding", *key, "bound").mapInPandas(elsewhere, "vec_id long, embedding array<double>, dim int, cell int, part int, bound double")
    found = written(ranked(at_home.union(searched(rest))).select("query_id", "rank", "vec_id", "score"), "vectors-best")
    dropped(dealt, at_home)
    return found
