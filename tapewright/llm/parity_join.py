"""Near duplicates by parity sketches: XOR-hashed shingles, a pigeonhole join, exact checks.

A document's shingles are dealt to N segments by hash and each segment keeps the XOR
of its shingles' bits.  Two documents differ in at most as many segments as their sets
differ in shingles (the Hamming distance of sketches bounds the symmetric difference
from below), and Jaccard similarity t allows at most D = (a + b)(1 - t)/(1 + t)
differing shingles for sets of sizes a and b.  So, under any common order of segment
values, the first D + 1 nonempty segments of both documents have a value in common as
long as one of them has more than D nonempty segments.  Documents for which this fails
(few shingles that happen to share segments) also join on single shingles, which always
suffice.  The order puts values that many documents hold last, so common passages rarely
cause candidates.  N depends on the size band [8^k, 8^(k+1)); a document also joins the
band below if a similar smaller document may be there.  Values have 48 bits: values that
fall together make candidates only.

Copies have one class (equal sets); a task names the buckets of a class once, however many
copies it reads, and buckets of very frequent values are salted.  In each bucket the classes
are linked in a chain; the links are checked (dense parity sketch first, then whole sets)
and give components.  Buckets that then still hold several components are compared within
tasks, those with the same members once, large ones in pairs of blocks: sketches tell which
members have any partner in another component, whole sets of these members which links are
true, and of the true ones a task returns a spanning forest, so no more rows than members
leave it.  So no link between components is lost, and no pairs of a group are listed.
Whole sets are compared as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingles import mix, shingle_set
from .storage import deleted, dropped, new_path, shared_dir, small_batches, written

#: Segments per shingle of a band's largest set, so that many more nonempty segments exist than are needed
#: and those that many documents hold can be left out.
SEGMENTS = 0.8
#: A size band's largest set has less than 2^BAND times the shingles of its smallest: of wide bands few documents join two.
BAND = 3
#: Bits of a join value: so many move with every bucket of a class.
VALUE_BITS = 48
#: Sizes from here on aren't told apart where buckets are cut by size, so there they are cut less.
LARGE = (1 << 16) - 1
#: Values held by fewer documents than this within one input split aren't reported as frequent by it, so a value that
#: is spread over many splits would go unnoticed however many documents hold it: all values of one class in ``SAMPLED``
#: (by its fingerprint) are counted over the whole table as well.
FREQUENT, SAMPLED = 3, 16
#: At most so many frequent values are told to all tasks (12 bytes each); the order of the others is by hash.
#: The order decides how many candidates there are, never which links are found.
TOLD = 500_000
#: Documents with one value that meet in one task; values of more documents are salted.
SALTED = 20_000
#: Shingles that a block of a large bucket holds together, about.
BLOCK = 1 << 19
#: Ids of candidates are broadcast up to this count, else joined by shuffle.
BROADCAST_IDS = 1_000_000


class Frequent:
    """How many documents hold a value, of the values (sorted) that are known as frequent."""

    def __init__(self, known: np.ndarray, count: np.ndarray):
        self.known, self.count = known, count
        self.mask = (1 << (8 * len(known)).bit_length()) - 1
        self.maybe = np.zeros(self.mask + 1, bool)
        self.maybe[known & self.mask] = True

    def times(self, values: np.ndarray) -> np.ndarray:
        """0 for values that aren't known; most of them are told by their last bits, without a search."""
        out = np.zeros(len(values), np.int64)
        at = np.flatnonzero(self.maybe[values & self.mask])
        if len(at):
            some = values[at]
            place = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
            out[at] = np.where(self.known[place] == some, self.count[place], 0)
        return out


class Rule:
    """What similarity num/den allows."""

    def __init__(self, num: int, den: int, width: int):
        if not den < 2 * num <= 2 * den:
            raise ValueError("the similarity must be over 1/2 and at most 1")
        self.num, self.den, self.width = num, den, width

    def differ(self, both: int) -> int:
        """The largest symmetric difference of two sets with so many shingles together."""
        return both * (self.den - self.num) // (self.den + self.num)

    def partner(self, n: int) -> int:
        return n * self.den // self.num

    def keys(self, x: np.ndarray, frequent: Frequent | tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Join values of one set; without ``frequent`` the values of all nonempty segments of its own band."""
        if isinstance(frequent, tuple):
            frequent = Frequent(*frequent)
        n = len(x)
        band = (n.bit_length() - 1) // BAND
        mixed = mix(x)
        own = self._role(x, mixed, band, self.differ(n + self.partner(n)), frequent)
        smaller = (1 << BAND * band) - 1
        if frequent is None or smaller * self.den < n * self.num or not smaller:
            return own
        return np.concatenate([own, self._role(x, mixed, band - 1, self.differ(n + smaller), frequent)])

    def _role(self, x: np.ndarray, mixed: np.ndarray, band: int, d: int, frequent: Frequent | None) -> np.ndarray:
        top = 1 << BAND * (band + 1)
        segments = max(4 * top if top <= 64 else 0, int(SEGMENTS * top))
        seg = ((x >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # in order, as x is
        start = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
        salt = np.uint64(band + 1) << np.uint64(40)
        keys = self._values(np.bitwise_xor.reduceat(mixed, start) ^ mix(seg[start] | salt))
        if frequent is None:
            return keys
        first = self._first(keys, d + 1, frequent)
        if len(keys) > d:
            return first
        return np.concatenate([first, self._first(self._values(mixed ^ mix(salt | np.uint64(1 << 39))), d + 1, frequent)])

    @staticmethod
    def _values(x: np.ndarray) -> np.ndarray:
        return (mix(x) >> np.uint64(64 - VALUE_BITS)).view(np.int64)

    @staticmethod
    def _first(keys: np.ndarray, n: int, frequent: Frequent) -> np.ndarray:
        if len(keys) <= n:
            return keys
        often = frequent.times(keys)
        if often.any():
            rare = keys[often == 0]
            # the order is by frequency first: enough unknown values need no sorting
            return np.partition(rare, n - 1)[:n] if len(rare) >= n else keys[np.lexsort((keys, often))[:n]]
        return np.partition(keys, n - 1)[:n]

    def sketch(self, x: np.ndarray) -> bytes:
        """Dense parity bits: the power of two that is at least twice the band's largest size, up to 2^16."""
        bits = min(4 << (len(x).bit_length() - 1), 1 << 16) if len(x) else 8
        bits = max(bits, 64)
        odd = np.bincount((mix(x ^ np.uint64(0x5BD1E995)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()


def fingerprint(x: np.ndarray) -> int:
    """A set's 64-bit name: equal for equal sets."""
    return int((mix(x).sum() ^ mix(np.array([len(x)], np.uint64))[0]).view(np.int64))


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parity sketches at the length of the shorter one: halves of the longer XOR together."""
    while len(a) > len(b):
        # position = hash mod bits, so the halves of the bit row fall on each other
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return a, b


def _members(rule: Rule):
    """Sizes, names and sketches of sets; values that are frequent in a task are rows of their own, and so are those of sampled classes, with ``times`` below 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        sample: dict[int, np.ndarray] = {}
        size = 0

        def close() -> pd.DataFrame:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= FREQUENT
            some, times = np.unique(np.concatenate([np.empty(0, np.int64), *sample.values()]), return_counts=True)
            told = {"value": np.concatenate([value[often], some]), "times": np.concatenate([count[often], -times])}
            return pd.DataFrame(told).reindex(columns=["doc_id", "row_key", "n", "fp", "sketch", "value", "times"]).astype({"value": "Int64", "times": "Int64"})

        for batch in batches:
            rows = []
            for doc_id, row_key, text in zip(batch["doc_id"], batch["row_key"], batch["text"], strict=True):
                x = shingle_set(text if isinstance(text, str) else None, rule.width)
                doc = None if pd.isna(doc_id) else int(doc_id)
                rows.append((doc, row_key, len(x), fingerprint(x) if len(x) else None, rule.sketch(x) if len(x) else b""))
                if len(x):
                    held.append(rule.keys(x, None))
                    size += len(held[-1])
                    if rows[-1][3] % SAMPLED == 0:
                        sample[rows[-1][3]] = held[-1]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            doc, key, n, fp, sketch = map(list, columns)
            # nulls must not turn long integers into floats
            yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "row_key": key, "n": n, "fp": pd.array(fp, "Int64"), "sketch": sketch}).assign(value=pd.NA, times=pd.NA)
            if size > 1_000_000:
                yield close()
                held, sample, size = [], {}, 0
        if held:
            yield close()

    return run


def _entries(rule: Rule, frequent: Frequent):
    """(entry, fp, salt) for each bucket of a text's class, once a task however many copies it holds; entry is the value and, in the last 16 bits, the size, of large sets ``LARGE``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            keys, names, sizes = [], [], []
            for text in batch["text"]:
                x = shingle_set(text if isinstance(text, str) else None, rule.width)
                fp = fingerprint(x) if len(x) else None
                if fp is not None and fp not in seen:
                    seen.add(fp)
                    keys.append(rule.keys(x, frequent))
                    names.append(fp)
                    sizes.append(len(x))
            if not keys:
                continue
            each = [len(k) for k in keys]
            fp, size = np.repeat(np.array(names, np.int64), each), np.repeat(np.minimum(np.array(sizes, np.int64), LARGE), each)
            key = np.concatenate(keys)
            salts = 1 + frequent.times(key) // SALTED
            yield pd.DataFrame({"entry": key << 16 | size, "fp": fp, "salt": np.where(salts > 1, 1 + fp % salts, 0)})

    return run


def frequent_values(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent segment values over all documents, by value; at most TOLD of them.

    They only set the order in which a document's segments are taken, never a result.  What two
    sampled classes hold is frequent too, with as many documents as the sample stands for.
    """
    split, sampled = (F.sum(F.when(test, F.abs("times")).otherwise(0)) for test in (F.col("times") > 0, F.col("times") < 0))
    found = signed.filter("value is not null").groupBy(F.col("value").alias("key")).agg(split.alias("split"), sampled.alias("sampled")).filter("split > 0 or sampled > 1")
    found = found.select("key", F.greatest("split", F.col("sampled") * SAMPLED).alias("n"))
    top = found.orderBy(F.desc("n"), "key").limit(TOLD).toPandas().sort_values("key")
    return top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def _similar_sketches(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and dense sketches allow a link."""
    num, den = rule.num, rule.den

    @F.pandas_udf("boolean")
    def near(sa: pd.Series, sb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = np.zeros(len(sa), bool)
        for i, (x, y, n, m) in enumerate(zip(sa, sb, na, nb, strict=True)):
            p, q = folded(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8))
            out[i] = int(np.bitwise_count(p ^ q).sum()) <= rule.differ(n + m)
        return pd.Series(out)

    side = classes.select("fp", "n", "sketch")
    a, b = (side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)) for s in "ab")
    joined = pairs.join(a, F.col("a") == F.col("fp_a")).join(b, F.col("b") == F.col("fp_b"))
    fits = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    return joined.filter(fits).filter(near("sketch_a", "sketch_b", "n_a", "n_b"))


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(fp, shingles) of the classes ``wanted`` (distinct fp): each one's text is read again once."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(fp, shingle_set(t, rule.width)) for fp, t in zip(batch["fp"], batch["text"], strict=True) if t]
            found = [(fp, x.tobytes()) for fp, x in found if len(x) and fingerprint(x) == fp]
            yield pd.DataFrame(found, columns=["fp", "shingles"]).astype({"fp": "int64"})

    wanted = written(wanted.join(classes.select("fp", "row_key"), "fp"), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    # other texts may share a row_key: their fingerprints tell them apart
    texts = docs.select("row_key", "text").join(F.broadcast(wanted) if few else wanted, "row_key").select("fp", "text")
    return texts.mapInPandas(sets, "fp long, shingles binary").dropDuplicates(["fp"])


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b) those whose whole sets are similar enough: exact."""
    num, den = rule.num, rule.den

    @F.pandas_udf("boolean")
    def linked(xs: pd.Series, ys: pd.Series) -> pd.Series:
        found = (_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(xs, ys, strict=True))
        return pd.Series(np.fromiter(found, bool, len(xs)))

    found = _sets(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), classes, docs, rule)
    a, b = (found.select(F.col("fp").alias(s), F.col("shingles").alias(f"x{s}")) for s in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").filter(linked("xa", "xb")).select("a", "b")


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * den >= num * (len(x) + len(y) - common)


def near_duplicates(docs: DataFrame, num: int = 3, den: int = 4, width: int = 5) -> DataFrame:
    """Components of documents linked by Jaccard similarity >= num/den of their word shingles.

    Returns one row per input row: doc_id, n_shingles (set size) and component_id (the
    smallest doc_id reachable, itself included).  A null, empty or blank text has no
    shingles and is its own component; fewer than ``width`` words are one shingle.
    Rows with equal texts, and repeated rows, share a component.  A null doc_id is linked
    like any other but never names a component unless all its members are null.
    row_key tells rows apart (the doc_id, else a hash of the text) and kept_key is the row_key
    of the one document that stands for its component.  Columns other than doc_id and text
    are not read; an empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    with small_batches(docs.sparkSession, 1000):
        return _near_duplicates(docs, Rule(num, den, width))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text))


def _near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    where = new_path(spark, "signatures")
    docs.mapInPandas(_members(rule), "doc_id long, row_key long, n int, fp long, sketch binary, value long, times long").write.parquet(where)
    signed = spark.read.parquet(where)
    told = spark.sparkContext.broadcast(frequent_values(signed))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _entries(rule, Frequent(*told.value))(batches)

    # buckets by size, cut where sizes allow no link any more; window rows stream, so a bucket needs no memory
    by_size = Window.partitionBy("key", "salt").orderBy("n", "fp")
    # rows are dealt out as they are and taken apart behind that: wider ones cost more the fewer of a class meet in a task
    value = F.shiftrightunsigned("entry", 16)
    rows = docs.select("text").mapInPandas(entries, "entry long, fp long, salt long").repartition(value, "salt")
    rows = rows.select(value.alias("key"), "salt", F.expr("entry & 65535").alias("n"), "fp")
    rows = rows.withColumn("last", F.lag("fp").over(by_size)).withColumn("n_last", F.lag("n").over(by_size)).filter("last is null or last <> fp")
    gap = F.when(F.col("n_last") * rule.den < F.col("n") * rule.num, 1).otherwise(0)
    rows = rows.withColumn("part", F.sum(gap).over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy("key", "salt", "part").orderBy("n", "fp")
    sides = {name: F.lag("fp", k).over(order) for name, k in (("before", 1), ("before2", 2), ("after", -1), ("after2", -2))}
    rows = rows.select("key", "salt", "part", "fp", *(c.alias(name) for name, c in sides.items())).filter("before is not null or after is not null or salt > 0")
    # the chain settles buckets of two
    wide = "salt > 0 or before2 is not null or after2 is not null or before is not null and after is not null"
    key = F.when(F.col("salt") > 0, F.col("key")).otherwise(F.xxhash64("key", "part"))
    shared = written(rows.select(key.alias("key"), "fp", "before", F.expr(wide).alias("wide")), "buckets")
    members = written(signed.filter("row_key is not null").select("doc_id", "row_key", "n", "fp"), "members")
    joined = signed.filter("n > 0").join(shared.select("fp").distinct(), "fp", "left_semi")
    classes = written(joined.groupBy("fp").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    deleted(spark, where)

    # first the neighbour with which a class shares most buckets, next all neighbours, last all that share a bucket
    chained = shared.filter("before is not null").groupBy(F.col("before").alias("a"), F.col("fp").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    near = written(_similar_sketches(chained, classes, rule).select("a", "b", "times"), "neighbours")
    ends = near.select("a", "b", "times", F.explode(F.array("a", "b")).alias("fp"))
    best = ends.groupBy("fp").agg(F.max(F.struct("times", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    links = written(_linked(best, classes, docs, rule), "links")
    labels = components(links)
    for step in (lambda: _linked(written(_apart(near.select("a", "b"), labels), "apart"), classes, docs, rule), lambda: _across(shared, labels, classes, docs, rule)):
        found = written(step(), "links")
        if not found.isEmpty():
            links = links.union(found)
            labels = components(links)
    for table in (shared, near, links):
        dropped(table)

    named = members.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lowest = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("row_key").alias("any_key"))
    out = named.join(lowest, "label", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row_key", F.coalesce("component_id", "any_key", "row_key").alias("kept_key"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose classes are not in one component."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _mixed(shared: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, fp, n, label) of the buckets that hold more than one component; of buckets with the same members one."""
    named = classes.select("fp", "n").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rows = shared.filter("wide").select("key", "fp").join(named, "fp")
    of = [F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("fp")).alias("h"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("g"), F.sum(F.col("n").cast("long")).alias("shingles")]
    mixed = rows.groupBy("key").agg(*of).filter("x <> y").groupBy("members", "h", "g").agg(F.min("key").alias("key"), F.first("shingles").alias("shingles"))
    return rows.join(mixed.select("key", "shingles"), "key")


def _across(shared: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between classes that share a bucket but no component; of those within one pair of blocks a spanning forest."""
    many = _mixed(shared, labels, classes).withColumn("blocks", F.ceil(F.col("shingles") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    many = many.select("key", "fp", "n", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    many = many.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "n", "label")

    def candidates(rows: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        """Members with a partner that the sketches allow; groups that keep the same members get the same key, i and j."""
        kept, sketch, fp = [], rows["sketch"].tolist(), rows["fp"].to_numpy(np.int64).view(np.uint64)
        i, j, own = (rows[c].to_numpy() for c in ("i", "j", "own"))

        def dense(some: np.ndarray) -> np.ndarray:
            size = min(len(sketch[k]) for k in some)
            # folding keeps the bound: halves of a parity sketch XOR together
            return np.stack([folded(np.frombuffer(sketch[k], np.uint8), np.zeros(size, np.uint8))[0] for k in some])

        for x, y, _ in _allowed(rows, groups, dense, rule):
            at = np.union1d(x, y)
            right = (own[at] == j[at]) & (i[at] != j[at])
            name = np.bitwise_xor.reduce(mix(mix(fp[at]) ^ right.astype(np.uint64))).view(np.int64)
            kept.append((at, np.full(len(at), name), (i[at] != j[at]).astype(int), right.astype(int)))
        if not kept:
            return rows.iloc[:0].drop(columns="sketch")
        at, key, two, right = map(np.concatenate, zip(*kept, strict=True))
        return rows.iloc[at].drop(columns="sketch").assign(key=key, i=0, j=two, own=right)

    def forest(rows: pd.DataFrame, groups: list[tuple[int, int]]) -> pd.DataFrame:
        sets, fp, label, out = [np.frombuffer(x, np.uint64) for x in rows["shingles"]], rows["fp"].tolist(), rows["label"].tolist(), []

        def dense(some: np.ndarray) -> np.ndarray:
            wide = max(64, 16 << (max(len(sets[k]) for k in some).bit_length() - 1))
            return np.stack([np.packbits((np.bincount((mix(sets[k]) & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1).astype(np.uint8)) for k in some])

        for x, y, apart in _allowed(rows, groups, dense, rule):
            root: dict[int, int] = {}

            def top(label: int, root: dict[int, int] = root) -> int:
                while (up := root.get(label, label)) != label:
                    root[label] = label = root.get(up, up)
                return label

            for at in np.argsort(apart, kind="stable").tolist():
                a, b = int(x[at]), int(y[at])
                la, lb = top(label[a]), top(label[b])
                if la != lb and _alike(sets[a], sets[b], rule.num, rule.den):
                    root[la] = lb
                    out.append((fp[a], fp[b]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    kind = "key long, i int, j int, own int, fp long, n int, label long"
    # one passage fills many buckets, in which the same few members are left
    left = written(_in_groups(many.join(classes.select("fp", "sketch"), "fp"), candidates, kind).dropDuplicates(["key", "i", "j", "own", "fp"]), "candidates")
    sets = _sets(left.select("fp").distinct(), classes, docs, rule)
    return _in_groups(left.join(sets, "fp"), forest, "a long, b long").distinct()


def _allowed(rows: pd.DataFrame, groups: list[tuple[int, int]], dense: Callable[[np.ndarray], np.ndarray], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of rows (start, end) with any: places of pairs, one from each block, of different labels, with sizes and sketches that allow a link, and the sketches' distances.

    ``dense`` gives the sketches of some rows, of one length.
    """
    size, label, own, i, j = (rows[c].to_numpy() for c in ("n", "label", "own", "i", "j"))
    size = size.astype(np.int64)
    num, den = rule.num, rule.den
    for start, end in groups:
        n, mark, of = size[start:end], label[start:end], own[start:end]
        if n.min() * den >= n.max() * num:
            near = None
        else:
            # members without any partner of a fitting size need no sketch
            ordered = np.sort(n)
            low, high = np.searchsorted(ordered, -(-n * num // den), "left"), np.searchsorted(ordered, n * den // num, "right")
            near = np.flatnonzero(high - low > 1)
            if len(near) < 2:
                continue
        if near is not None:
            n, mark, of = n[near], mark[near], of[near]
        if (mark == mark[0]).all():
            continue
        one = i[start] == j[start]
        left, right = (np.arange(len(n)),) * 2 if one else (np.flatnonzero(of == i[start]), np.flatnonzero(of == j[start]))
        if not len(left) or not len(right):
            continue
        place = start + (near if near is not None else np.arange(len(n)))
        sketch = dense(place)
        sketch = sketch.view(np.uint64) if sketch.shape[1] % 8 == 0 else sketch
        step, out = max(1, (1 << 23) // (len(right) * sketch.shape[1] * sketch.itemsize)), []
        for at in range(0, len(left), step):
            p = left[at : at + step, None]
            low, high = np.minimum(n[p], n[right]), np.maximum(n[p], n[right])
            ok = (mark[p] != mark[right]) & (low * den >= high * num)
            if one:
                ok &= p < right
            x, y = np.nonzero(ok)
            if not len(x):
                continue
            x, y = p[x, 0], right[y]
            apart = np.concatenate([np.bitwise_count(sketch[x[k : k + (1 << 18)]] ^ sketch[y[k : k + (1 << 18)]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 1 << 18)])
            ok = apart <= (n[x] + n[y]) * (den - num) // (den + num)
            out.append((place[x[ok]], place[y[ok]], apart[ok]))
        if out and sum(len(x[0]) for x in out):
            yield tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _in_groups(rows: DataFrame, work: Callable[[pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], kind: str) -> DataFrame:
    """``work`` on rows that hold whole groups (key, i, j); groups are small and many, so a task takes them from its sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def whole() -> pd.DataFrame:
            table = pd.concat(held, ignore_index=True)
            group = table[["key", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(table)]
            return work(table, list(zip(cuts[:-1], cuts[1:], strict=True)))

        for batch in batches:
            if not len(batch):
                continue
            group = batch[["key", "i", "j"]].to_numpy()
            first = int(np.argmax((group == group[-1]).all(axis=1)))  # of the last group, which may go on
            if first or last is not None and (last != group[0]).any():
                held.append(batch.iloc[:first])
                yield whole()
                held = []
            held.append(batch.iloc[first:])
            last = group[-1]
        if held:
            yield whole()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, kind)
