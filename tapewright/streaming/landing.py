"""Watching a landing folder: each new file runs through the batch functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import contracts
from ..operators import chain
from ..sources import landing_table, tapes


def stream_rows(spark: SparkSession, folder: str, headers: list[str], files_per_batch: int = 100) -> DataFrame:
    """Rows of CSV files as they land, with the file they come from."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    rows = spark.readStream.schema(schema).options(header=True, multiLine=True, escape='"', maxFilesPerTrigger=files_per_batch).csv(folder)
    return rows.withColumn("raw_file_id", F.col("_metadata.file_path"))


def records_of(rows: DataFrame, kind: str, headers: list[str]) -> DataFrame:
    """Typed records of streamed rows.  Numbers within a file aren't known in a stream; rows are named by content."""
    mapping, _ = tapes.column_mapping(headers)
    payload = F.map_from_arrays(F.array(*map(F.lit, headers)), F.array(*(F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in headers)))
    named = F.sha2(F.concat_ws("#", "raw_file_id", *(F.coalesce(F.col(f"`{h}`"), F.lit("")) for h in headers)), 256)
    raw = rows.select(
        "raw_file_id", F.lit(0).alias("row_number"), named.alias("raw_record_id"), F.lit(contracts.FILE_SOURCES[kind]).alias("source_system"), payload.alias("payload"), F.lit(None).cast("string").alias("parse_error")
    )
    return tapes.normalised(raw, mapping)


def watch(records: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hand every micro-batch of records to a batch function; ``once`` stops when all that is there is done."""
    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and key, finished when the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


#: What is kept of a loan between micro-batches: the place of its last row, versions by source, number and digest of its last link.
STATE = "batch_no long, file_no int, row_number int, sources array<string>, versions array<long>, seq long, tip string"


def linked_versions(records: DataFrame, fields: list[str]) -> DataFrame:
    """Streamed records with the ``version`` of their (loan, source) and their link in the loan's chain: seq, prev_hash, hash.

    ``records``: loan_id, source_system, batch_no, file_no, row_number and the text columns ``fields``
    that the digest covers; other columns are dropped.  Versions and links go on from what earlier
    micro-batches left in the state, which holds a loan's few sources and no rows.  Rows at or before a
    loan's last place were counted already (a batch that landed again after a kill) and give nothing.
    The result is that of the batch functions ``tapes.versioned`` and ``chain.appended`` over all
    rows in the order of landing, provided that batches arrive in that order.
    """
    keep = list(dict.fromkeys(["loan_id", "source_system", *landing_table.ORDER, *fields]))
    keys = sorted([*fields, chain.PREV])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(list(landing_table.ORDER))
        batch_no, file_no, row_number, sources, versions, seq, tip = state.get if state.exists else (-1, -1, -1, [], [], 0, None)
        place, last = (batch_no, file_no, row_number), dict(zip(sources, versions, strict=True))
        out = []
        for r in rows.to_dict("records"):
            here = tuple(int(r[c]) for c in landing_table.ORDER)
            if here <= place:
                continue
            place, seq = here, seq + 1
            version = last[r["source_system"]] = last.get(r["source_system"], 0) + 1
            told = {f: r[f] for f in fields} | {chain.PREV: tip}
            before, tip = tip, hashlib.sha256(chain.canonical_json({k: told[k] for k in keys}).encode()).hexdigest()
            out.append((*(r[c] for c in keep), version, seq, before, tip))
        state.update((*place, list(last), list(last.values()), seq, tip))
        yield pd.DataFrame(out, columns=[*keep, "version", "seq", "prev_hash", "hash"])

    types = {c: t for c, t in records.dtypes}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", version long, seq long, prev_hash string, hash string"
    return records.select(*keep).groupBy("loan_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
