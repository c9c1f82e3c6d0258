"""Sharding along a Hilbert curve over metadata, for files that prune in several dimensions.

Each dimension is quantised to ``bits`` bits.  The curve index of every occupied cell is
computed once (cells are few: 2^(dimensions x bits) at most); rows are ordered by curve
index, and runs of equal row counts are cut from that order.  Only DataFrame and SQL
functions are used.

The order of all rows comes from counts, not from one global sort: cells, and shares of
cells with very many rows, are counted; a prefix sum over these counts gives each its
first position; and rows are numbered within their share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_dimensions(bits: int) -> list[Column]:
    """Language and source (hashed to the grid) and the logarithm of the length."""
    top = (1 << bits) - 1
    length = F.floor(F.log2(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)) + F.lit(1)) * (1 << bits) / 20)
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")
    return [hashed("lang"), F.least(length, F.lit(top)).cast("int"), hashed("source")]


def hilbert_index(dims: list[str], bits: int) -> Column:
    """Curve index of integer columns of ``bits`` bits each.

    From the highest bit down, one bit of each dimension gives the corner of a cube.  The
    corner, turned by the state (entry corner e, direction d), is looked up in the Gray
    code, and the state of the subcube it leads to follows.
    """
    n = len(dims)
    size, mask = 1 << n, (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(size)]
    inverse = [gray.index(i) for i in range(size)]
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(size)]
    turn = [0 if i == 0 else trailing(i - 1) % n if i % 2 == 0 else trailing(i) % n for i in range(size)]
    table = lambda xs: f"array({','.join(map(str, xs))})"
    corner = "|".join(f"shiftleft(shiftright(`{c}`, i) & 1, {j})" for j, c in enumerate(dims))
    turned = f"((shiftright((({corner}) ^ a.e), a.d + 1) | shiftleft((({corner}) ^ a.e), {n} - a.d - 1)) & {mask})"
    rolled = f"((shiftleft({table(entry)}[w], a.d + 1) | shiftright({table(entry)}[w], {n} - a.d - 1)) & {mask})"
    step = f"named_struct('h', a.h * {size} + w, 'e', a.e ^ {rolled}, 'd', (a.d + {table(turn)}[w] + 1) % {n})"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 'e', 0, 'd', 0),"
        f" (a, i) -> element_at(transform(array({table(inverse)}[{turned}]), w -> {step}), 1), a -> a.h)"
    )


def curve_positions(rows: DataFrame, dimensions: int, bits: int, share: int = 4096) -> DataFrame:
    """``rows`` (with ``cell`` array<int>, ``spread`` long and ``tie`` columns) with curve, position and total.

    A cell with more than ``share`` rows is dealt to shares by ``spread``, so that no task
    numbers a whole hot cell.  Positions run from 0 without gaps.
    """
    dims = [f"q{i}" for i in range(dimensions)]
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("cell", F.ceil(F.col("n") / share).cast("long").alias("shares"), *(F.col("cell")[i].alias(c) for i, c in enumerate(dims)))
    cells = cells.select("cell", "shares", hilbert_index(dims, bits).alias("curve"))
    # at most 2^(n * bits) rows, whatever the number of documents
    dealt = rows.join(F.broadcast(cells), "cell").withColumn("share", F.pmod("spread", "shares"))
    counts = dealt.groupBy("curve", "share").agg(F.count(F.lit(1)).alias("n"))
    along = Window.orderBy("curve", "share")
    starts = counts.select("curve", "share", (F.sum("n").over(along) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("curve", "share").orderBy("tie")
    numbered = dealt.withColumn("row", F.row_number().over(within))
    return numbered.join(starts, ["curve", "share"]).withColumn("position", F.col("start") + F.col("row") - 1).drop("row", "start", "share", "shares", "spread", "tie", "cell")


def shards(docs: DataFrame, n: int = 8, bits: int = 5) -> DataFrame:
    """Place every document in one of ``n`` shards, runs of the curve whose row counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ("rows"), shard,
    slot (from 0 in each shard), grown_shard (null) and curve.  Within a share of a cell copies of a
    text lie together; cells of many rows are dealt to shares by doc_id and length, and rows
    that repeat both share one.  A null text has size 1 and the checksum of no bytes; a null doc_id,
    lang, source or n_chars has a place like any other value; repeated rows get places of
    their own; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    cell = F.array(*document_dimensions(bits)).alias("cell")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        cell,
        F.xxhash64("doc_id", "n_chars").alias("spread"),
        F.struct(F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("d")).alias("tie"),
    )
    placed = curve_positions(rows, 3, bits)
    shard = F.expr(f"position * {n} div total")
    first = F.expr(f"(position * {n} div total * total + {n - 1}) div {n}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(docs: DataFrame, out: str, n: int = 8, bits: int = 5) -> None:
    """Write whole rows of ``docs`` as one folder a shard, the shards that ``shards`` gives, in curve order within each file.

    Files hold neighbouring cells only, so their min and max statistics prune by language,
    source and length alike.  Rows go to files by ranges of their place on the curve, so a shard
    may have many files and no task writes a whole one.  Columns of any names are kept; the folders are named
    shard, with _ behind it until it is no column of ``docs``.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.array(*document_dimensions(bits)).alias("cell"), F.xxhash64("doc_id", "n_chars").alias("spread"), F.struct(F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("d")).alias("tie"))
    placed = curve_positions(rows, 3, bits)
    name = "shard"
    while name in docs.columns:
        name += "_"
    dealt = placed.select("doc", "position", F.expr(f"position * {n} div total").cast("int").alias("part"))
    ordered = dealt.repartitionByRange("position").sortWithinPartitions("position")
    ordered.select("doc.*", F.col("part").alias(name)).write.partitionBy(name).parquet(out)
