"""Shared folders for tables that an operator writes and reads again."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import deleted, new_path, shared_dir, written

__all__ = ["deleted", "dropped", "new_path", "shared_dir", "small_batches", "written"]


def dropped(*tables: DataFrame) -> None:
    """Remove the written tables that these rows come from; nothing may read them any more."""
    for table in tables:
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            deleted(table.sparkSession, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in the jobs run meanwhile: rows that hold whole texts or sets are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
