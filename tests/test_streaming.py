"""Landings in micro-batches against the batch functions over all rows."""

import json

from pyspark.sql import functions as F

from tapewright.operators import chain
from tapewright.sources import landing_table, tapes
from tapewright.sources.landing_table import LandingTable, Upload
from tapewright.streaming import landing

FIELDS = ["loan_id", "principal"]


def flat(records):
    return records.select("source_system", *landing_table.ORDER, F.col("data.loan_id").alias("loan_id"), F.col("data.original_principal").cast("string").alias("principal"))


def test_two_landings_equal_the_batch_run(spark, tmp_path):
    table = LandingTable(spark, str(tmp_path / "raw"))
    headers = ["loan_id", "original_principal"]
    mapping = tapes.column_mapping(headers)[0]

    def upload(name, kind, *cells):
        (tmp_path / name).write_text("loan_id,original_principal\n" + "".join(f"{a},{b}\n" for a, b in cells))
        return Upload(str(tmp_path / name), kind)

    def step():
        records = flat(tapes.normalised(table.stream(), mapping))
        out = landing.linked_versions(records.filter("loan_id is not null"), FIELDS)
        query = landing.watch(out, str(tmp_path / "checkpoint"), lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")))
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    table.land([upload("a.csv", "loan_tape", ("L1", 1), ("L2", 2), ("L1", 3), ("", 9)), upload("b.csv", "servicer_update", ("L1", 4), ("L3", 5))])
    assert step().count() == 5
    table.land([upload("c.csv", "loan_tape", ("L2", 6), ("L1", 7), ("L4", "bad"))])
    got = step()
    assert step().count() == got.count() == 8  # nothing new has landed
    whole = flat(tapes.normalised(table.rows(), mapping)).filter("loan_id is not null")
    versions = tapes.versioned(whole, ["loan_id", "source_system"], list(landing_table.ORDER))
    linked = chain.appended(whole, ["loan_id"], list(landing_table.ORDER), FIELDS)
    want = versions.join(linked.select(*landing_table.ORDER, "prev_hash", "hash"), list(landing_table.ORDER))
    columns = ["loan_id", "source_system", *landing_table.ORDER, "principal", "version", "prev_hash", "hash"]
    assert sorted(json.dumps(list(r)) for r in got.select(columns).collect()) == sorted(json.dumps(list(r)) for r in want.select(columns).collect())
    assert got.filter("loan_id = 'L1'").agg(F.max("seq")).first()[0] == 4
    # a batch that comes again, as after a kill before its manifest, adds nothing
    spark.read.parquet(f"{table.path}/data/{'{:08d}-{}'.format(*table.batches()[0])}").write.parquet(f"{table.path}/data/again")
    assert step().count() == 8


def test_windows_close_when_the_watermark_has_passed(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 09:00:00", "b")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    query = landing.running_counts(events, "t", "k").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.k, r.n) for r in spark.table("closed").collect()] == [("a", 2)]
