"""Small-change tables by natural key: a merge rewrites only the buckets it changes and swaps the snapshot in one step."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .landing_table import names_in, put_text


class Snapshots:
    """A table under ``path`` whose rows are named by ``keys`` (nulls among them are values).

    Rows lie in buckets of their key's hash.  Each version names the folder of every bucket;
    the highest version holds.  A reader keeps its version whatever is merged meanwhile, and a
    merge that was killed leaves the last version as it was.  One writer at a time: of two,
    the later one fails.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 8):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def version(self) -> int:
        return max((int(n) for n in names_in(self.spark, f"{self.path}/versions", ".json")), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the highest by default), of some buckets only if they are given."""
        folders = self._folders(self.version() if version is None else version)
        paths = [f"{self.path}/data/{p}" for b, p in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, order: str | None = None) -> int:
        """Rows of ``changes`` replace those of equal key or come anew; the version that then holds.

        With ``order`` the latest of several changes of one key wins; without it they must be one a
        key.  Rows that are equal already change nothing: a merge repeated makes no new version.
        """
        version, columns = self.version(), self.spark.createDataFrame([], self.schema).columns
        if order:
            newest = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*(c for c in columns if c not in self.keys)), order).alias("_x"))
            changes = newest.select(*self.keys, "_x.*")
        new = changes.select(*columns).withColumn("_bucket", self._bucket())
        held = self.read(version).select(*(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_held"))
        same_key = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in self.keys))
        kinds = dict(new.dtypes)
        # maps can't be compared, their texts can
        plain = lambda c, of: F.to_json(F.struct(F.col(of).alias("x"))) if "map<" in kinds[c] else F.col(of)
        equal = reduce(lambda a, b: a & b, (plain(c, c).eqNullSafe(plain(c, f"_old_{c}")) for c in columns))
        real = new.join(held, same_key, "left").filter(F.col("_held").isNull() | ~equal).select(*columns, "_bucket")
        touched = [r[0] for r in real.select("_bucket").distinct().collect()]
        if not touched:
            return version
        folder, folders = uuid.uuid4().hex, self._folders(version)
        olds = self.read(version, touched)
        gone = real.select(*(F.col(k).alias(f"_new_{k}") for k in self.keys))
        kept = olds.join(gone, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in self.keys)), "left_anti").withColumn("_bucket", self._bucket())
        whole = kept.unionByName(real)
        # twice the same key would come twice: refused before anything is swapped
        # few files a bucket, yet no bucket is one task's work if it is large
        whole.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/data/{folder}")
        if not written.groupBy(*self.keys).count().filter("count > 1").isEmpty():
            raise ValueError("several changes of one key")
        folders |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        put_text(self.spark, json.dumps(folders), f"{self.path}/versions/{version + 1}.json")
        return version + 1
