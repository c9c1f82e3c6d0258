import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tapewright.llm.hilbert import hilbert_index, shards, write_shards


def held(rows, docs, n=8):
    """The law "rows" and every column, against the input."""
    assert len(rows) == len(docs)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in rows) == sorted(((d is None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[i]) for i in range(n)]
    assert max(counts) - min(counts) <= 1


def test_shards_of_messy_rows(messy, messy_rows, empty):
    held(shards(messy).collect(), messy_rows)
    assert shards(empty).collect() == []


def test_shards_follow_the_curve(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = shards(docs).collect()
    held(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    in_order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert in_order == sorted(in_order)


def test_a_hot_cell_is_shared(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'same' text", "'en' lang", "'s' source", "4L n_chars")
    held(shards(docs).collect(), [(i, "same") for i in range(20_000)])


def test_the_curve_visits_neighbours(spark):
    for n in (2, 3):
        cells = spark.range(8**n).select(*(F.expr(f"cast(shiftright(id, {3 * i}) & 7 as int)").alias(f"q{i}") for i in range(n)))
        dims = [f"q{i}" for i in range(n)]
        path = [tuple(r)[1:] for r in cells.select(hilbert_index(dims, 3).alias("h"), *dims).orderBy("h").collect()]
        assert len(path) == 8**n and all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_written_shards_hold_all_rows(spark, messy, tmp_path):
    write_shards(messy, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(messy.columns) < set(back.columns) and back.count() == messy.count()


def test_files_follow_the_shards_and_prune(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("shard", F.lit("own"))
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.shard_ for r in back.collect()} == {r.doc_id: r.shard for r in shards(docs, 4).collect()}
    # runs of the curve leave whole shards out for a language, where dealing by hash would leave none
    of = {r.lang: r.n for r in back.groupBy("lang").agg(F.count_distinct("shard_").alias("n")).collect()}
    assert min(of.values()) < 4
