"""A training-data pipeline over ``documents``: toxicity, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and
read again as the next stage's documents.  All stages but the last return the columns of
``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.bpe import encode_decode
from tapewright.llm.mixing import Plan, mix
from tapewright.llm.parity_join import BROADCAST_IDS, near_duplicates, row_key
from tapewright.llm.queries import tokenizer_path
from tapewright.llm.storage import small_batches, written
from tapewright.llm.toxicity import accepted, fit

#: Nine tenths of the tokens, by equal weights at every level, no document twice.
MIX = Plan(budget=0.9, epochs=1, seed=23)
#: Whole texts that go to a Python worker at once; executors and workers hold each batch several times over.
BATCH = 1000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels among them, doesn't take for toxic."""
    with small_batches(spark, BATCH):  # written meanwhile: batches are cut when a job runs
        model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return written(accepted(docs, model), "accepted")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Rows without doc_id go if their group has one with a doc_id, and stay once a text
    otherwise; of rows that repeat the kept doc_id and text one stays.
    """
    groups = near_duplicates(docs, 3, 4, 5)
    others = groups.filter("row_key <> kept_key").select("row_key").distinct()
    again = groups.filter("row_key = kept_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_key")
    # keys to leave out are few beside the texts: where they can be sent to all tasks, no text is shuffled
    told = written(others.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True))), "told")
    few = told.count() <= BROADCAST_IDS
    out, again = (F.broadcast(keys) if few else keys for keys in (told.select("row_key"), told.filter("again").select("row_key")))
    # whole rows in one column: theirs may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    single = keyed.join(out, "row_key", "left_anti")
    repeated = keyed.join(again, "row_key", "left_semi").withColumn("text", F.col("doc.text")).dropDuplicates(["row_key", "text"]).drop("text")
    return single.unionByName(repeated).select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixing plan takes."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("doc"))
    return mix(rows, MIX, ["doc"]).select("doc.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    with small_batches(spark, BATCH):
        return written(encode_decode(docs, tokenizer_path()), "codes")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicate),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Learned scores and BPE merges are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each reads what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
