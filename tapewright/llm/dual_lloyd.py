"""Lloyd's rounds with two trees: a forest of cover trees over the vectors, one tree over the centroids.

The task that reads a run of vectors builds a cover tree over it, once; the trees are a
table.  In each round a tree over the centroids goes to every task.  A pair of nodes is left
out when its distance, less both radii, is above what another centroid guarantees to every
vector of the node; a node with one centroid left belongs to it as a whole.  What is left of
leaves and single centroids is compared exactly, in integers.  Tasks send sums and counts by
centroid, never vectors, and Spark adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cover_tree import Node, cover_tree
from .storage import dropped, new_path, small_batches, written
from .vectors import usable

#: Vectors of one tree, about; the largest component whose squared distances are sure to fit 64 bits.
GROUP, LARGEST = 4096, 2**27
#: Pairs of rows or nodes that are subtracted at once.
PAIRS = 1 << 15
TREES = "ids array<long>, vectors binary, parents binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass
class Flat:
    """A cover tree in arrays: node i holds rows ``first[i]`` to ``last[i]`` of ``order`` and children ``kids[i]`` to ``kids_end[i]``."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kids: np.ndarray
    kids_end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def flattened(root: Node, alone: bool) -> Flat:
    """The tree in arrays, children of a node side by side.  ``alone``: every leaf is one row of radius 0."""
    nodes, kids = [root], []
    for node in nodes:  # grows meanwhile
        parts = list(node.children)
        if alone and (parts or len(node.rows) > 1):
            parts += [Node(np.empty(0), 0.0, node.single[i : i + 1]) for i in range(len(node.single))]
        elif parts and len(node.single):
            parts.append(Node(node.centre, node.radius, node.single))
        kids.append((len(nodes), len(nodes) + len(parts)))
        nodes += parts
    size = np.array([len(n.rows) for n in nodes])
    first = np.zeros(len(nodes), np.int64)
    for i, (a, b) in enumerate(kids):
        first[a:b] = first[i] + np.cumsum(size[a:b]) - size[a:b]
    order = np.empty(size[0], np.int64)
    for i, (a, b) in enumerate(kids):
        if a == b:
            order[first[i] : first[i] + size[i]] = nodes[i].rows
    # a node's centre is its first row; the rest of a node has its parent's
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    centre = np.array([place[n.rows[0]] for n in nodes])
    for i, (a, b) in enumerate(kids):
        if not alone and b > a and nodes[b - 1].radius == nodes[i].radius and nodes[b - 1].centre is nodes[i].centre:
            centre[b - 1] = centre[i]
    ends = np.array(kids).reshape(-1, 2)
    return Flat(order, first, first + size, ends[:, 0], ends[:, 1], centre, np.array([0.0 if alone and a == b else n.radius for n, (a, b) in zip(nodes, kids, strict=True)]))


def tree_of(x: np.ndarray, alone: bool = False) -> Flat:
    return flattened(cover_tree(x.astype(float), np.arange(len(x)), *([1] if alone else [])), alone)


def _spread(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``at`` with each number from its ``first`` up to its ``last``."""
    n = last - first
    start = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), np.repeat(first, n) + np.arange(n.sum()) - start


def nearest(x: np.ndarray, tree: Flat, c: np.ndarray, over: Flat, count: Callable[[int], None] = lambda n: None) -> np.ndarray:
    """The nearest of the centroids ``c`` for each row of ``x`` (both integers, ``x`` in the tree's order); ties to the smaller number.

    ``over`` is the tree of the centroids.  ``count`` is told how many distances are computed.
    """
    xs, cs = x.astype(float), c[over.order].astype(float)
    out = np.full(len(x), -1, np.int32)
    single = over.kids == over.kids_end
    leaf = tree.kids == tree.kids_end
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        dist = np.empty(len(a))
        for i in range(0, len(a), PAIRS):
            part = slice(i, i + PAIRS)
            dist[part] = np.sqrt(((xs[tree.centre[a[part]]] - cs[over.centre[b[part]]]) ** 2).sum(axis=1))
        count(len(a))
        # a node's centre is a centroid itself; the slack covers rounding, so that ties stay
        sure = np.full(len(leaf), np.inf)
        np.minimum.at(sure, a, dist + tree.radius[a])
        near = dist - tree.radius[a] - over.radius[b] <= sure[a] * (1 + 1e-9) + 1e-6
        a, b = a[near], b[near]
        n = np.bincount(a, minlength=len(leaf))
        open_ = np.zeros(len(leaf))
        np.maximum.at(open_, a, np.where(single[b], 0, over.radius[b]))
        some_open = np.zeros(len(leaf), bool)
        some_open[a[~single[b]]] = True
        whole = (n[a] == 1) & single[b]
        for node, of in zip(a[whole], b[whole], strict=True):
            out[tree.first[node] : tree.last[node]] = over.order[over.first[of]]
        split_c = some_open[a] & ((open_[a] >= tree.radius[a]) | leaf[a])
        exact = ~whole & leaf[a] & ~some_open[a]
        split_x = ~whole & ~split_c & ~exact
        held.append((a[exact], b[exact]))
        stay = split_c & single[b]
        down, to = split_c & ~single[b], split_x
        ca, cb = _spread(a[down], over.kids[b[down]], over.kids_end[b[down]])
        at, xa = _spread(np.flatnonzero(to), tree.kids[a[to]], tree.kids_end[a[to]])
        a, b = np.concatenate([a[stay], ca, xa]), np.concatenate([b[stay], cb, b[at]])
    leaves, of = (np.concatenate(z) for z in zip(*held, strict=True))
    numbers = over.order[over.first[of]]
    order = np.lexsort((numbers, leaves))
    leaves, numbers = leaves[order], numbers[order]
    for node in np.unique(leaves):
        mine = numbers[np.searchsorted(leaves, node) : np.searchsorted(leaves, node, "right")]
        step = max(1, PAIRS // len(mine))
        for i in range(tree.first[node], tree.last[node], step):
            rows = slice(i, min(i + step, tree.last[node]))
            d = ((x[rows, None, :] - c[None, mine, :]) ** 2).sum(axis=2)
            count(d.size)
            out[rows] = mine[d.argmin(axis=1)]
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of vectors in the order of their trees; ``parents`` has the arrays of the tree."""
    ids: list[pa.Array] = []
    rows: list[np.ndarray] = []

    def tree() -> pa.RecordBatch:
        x, names = np.concatenate(rows), pa.concat_arrays(ids)
        flat = tree_of(x)
        shape = np.stack([flat.first, flat.last, flat.kids, flat.kids_end, flat.centre, flat.radius.view(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array([names.take(pa.array(flat.order)).to_pylist()], pa.list_(pa.int64())), pa.array([x[flat.order].tobytes()]), pa.array([shape.tobytes()])], ["ids", "vectors", "parents"])

    for batch in batches:
        for i in range(0, len(batch), GROUP):
            part = batch.slice(i, GROUP)
            x = part.column(1).flatten().to_numpy().reshape(len(part), -1)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError("components are too large for squared distances in 64 bits")
            ids.append(part.column(0))
            rows.append(x.astype(np.int32))
            if sum(map(len, rows)) >= GROUP:
                yield tree()
                ids.clear()
                rows.clear()
    if rows:
        yield tree()


def _read(ids: pa.Array, vectors: bytes, parents: bytes) -> tuple[np.ndarray, Flat]:
    x = np.frombuffer(vectors, np.int32).reshape(len(ids), -1).astype(np.int64)
    first, last, kids, kids_end, centre, radius = np.frombuffer(parents, np.int64).reshape(6, -1)
    return x, Flat(np.arange(len(ids)), first, last, kids, kids_end, centre, radius.view(float))


def _sums(trees: DataFrame, c: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, sum of components) of each centroid's vectors."""
    over = tree_of(c, alone=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            for ids, vectors, parents in zip(*batch.columns, strict=True):
                x, tree = _read(ids, vectors.as_py(), parents.as_py())
                of = nearest(x, tree, c, over)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order], prepend=-1))
                total[of[order][cuts]] += np.add.reduceat(x[order], cuts)
                n += np.bincount(of, minlength=len(c))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = trees.mapInArrow(run, "cluster int, n long, total array<long>")
    # one short row for each component and centroid
    added = parts.select("cluster", "n", F.posexplode("total").alias("j", "v")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(added, key=lambda r: (r["cluster"], r["j"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(r["v"])
    return out


def starts(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``<seed>:<vec_id>``; ties by components."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")), 256)
    rows = kept.filter("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, components: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """Clusters of integer vectors floor(scale x) after so many rounds, and one more assignment.

    Returns vec_id, cluster, distance (squared, to the final centroid), cluster_inertia and
    inertia (distances summed over the cluster and over all), centroid_sha256.  Exact: ties
    go to the smaller number, means are rounded down, empty centroids stay.

    Vectors of another length, null ones and such with null or non-finite components take no
    part.  Each row is a vector of its own, also where rows repeat or share a vec_id; rows
    without a vec_id are left out, as they can't be named.  With fewer than ``k`` vectors there are as many
    centroids as vectors; an empty table gives an empty result; other columns are not read.
    Components beyond 2^27 are refused: their squared distances need not fit 64 bits.
    ``k`` centroids are held by the driver and each task.
    """
    spark = vectors.sparkSession
    kept = usable(vectors).filter(F.size("embedding") == components).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))
    c = starts(kept, k, seed)
    if not len(c):
        return spark.createDataFrame([], RESULT)
    path = new_path(spark, "trees")
    with small_batches(spark, GROUP):
        kept.mapInArrow(_trees, TREES).write.option("parquet.block.size", 16 << 20).parquet(path)
    trees = spark.read.schema(TREES).parquet(path)
    with small_batches(spark, 4):
        for _ in range(rounds):
            for cluster, (n, total) in _sums(trees, c).items():
                c[cluster] = [s // n for s in total]
        found = written(_assigned(trees, c), "clusters")
    dropped(trees)
    by_cluster = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = {i: hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest() for i in by_cluster}
    return _with_totals(spark, found, by_cluster, digest)


def _assigned(trees: DataFrame, c: np.ndarray) -> DataFrame:
    over = tree_of(c, alone=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, parents in zip(*batch.columns, strict=True):
                x, tree = _read(ids, vectors.as_py(), parents.as_py())
                of = nearest(x, tree, c, over)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(of, pa.int32()), pa.array(((x - c[of]) ** 2).sum(axis=1), pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def _with_totals(spark: SparkSession, found: DataFrame, by_cluster: dict[int, int], digest: dict[int, str]) -> DataFrame:
    """The rows with what belongs to their cluster: at most as many rows as there are centroids."""
    rows = pd.DataFrame({"cluster": list(by_cluster), "cluster_inertia": list(by_cluster.values()), "inertia": sum(by_cluster.values()), "centroid_sha256": [digest[i] for i in by_cluster]})
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
