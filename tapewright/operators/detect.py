"""Detectors over whole tables: duplicates, clones, bursts, and conflicts between sources.

Groups are summed up before they are shuffled and joined back, so a key that holds a large
part of all rows is split by adaptive execution instead of filling one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _there(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _marked(rows: DataFrame, groups: DataFrame, on: list[str], keys: list[str], out: str) -> DataFrame:
    """fail for rows of the groups, not_applicable without a key, else pass."""
    flagged = groups.select(*(F.col(c).alias(f"_g_{c}") for c in on), F.lit(True).alias("_hit"))
    # rows without keys find no group: nulls don't join, and a null partition is matched by itself
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in on])
    joined = rows.join(flagged, condition, "left").select(*rows.columns, "_hit")
    return joined.withColumn(out, F.when(~_there(keys), "not_applicable").when(F.col("_hit"), "fail").otherwise("pass")).drop("_hit")


def duplicate_key(rows: DataFrame, keys: list[str], partition: list[str] | None = None, out: str = "result") -> DataFrame:
    """fail for every row of a (partition, keys) group of more than one."""
    on = [*(partition or []), *keys]
    groups = rows.filter(_there(keys)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return _marked(rows, groups, on, keys, out)


def fingerprint_duplicate(rows: DataFrame, keys: list[str], identity: str, out: str = "result") -> DataFrame:
    """fail for rows whose keys occur under more than one identity; a null identity is one of its own."""
    who = F.col(identity).cast("string")
    counted = rows.filter(_there(keys)).groupBy(*keys).agg(F.min(who).alias("_a"), F.max(who).alias("_b"), F.count_if(who.isNull()).alias("_none"))
    groups = counted.filter("_a <> _b or (_none > 0 and _a is not null)")
    return _marked(rows, groups, keys, keys, out)


def repeat_pattern(rows: DataFrame, key: str, when: str, more_than: int, days: int, out: str = "result") -> DataFrame:
    """fail for rows within any span of ``days`` days, both ends included, that holds more than ``more_than`` rows of a key.

    A span starts at a row.  Rows are first counted per (key, time); time is cut into blocks
    as long as a span, and a block is looked at with its neighbour, so even a single key
    with very many rows is spread over tasks.
    """
    micros = F.unix_micros(F.col(when).cast("timestamp"))
    span = (days + 1) * 86_400_000_000 - 1  # whole days count
    seen = rows.filter(F.col(key).isNotNull() & F.col(when).isNotNull())
    times = seen.groupBy(key, micros.alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col("_t") / (span + 1)).cast("long")

    def spread(df: DataFrame, step: int) -> DataFrame:
        return df.withColumn("_own", block).withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + step)))

    ahead = Window.partitionBy(key, "_block").orderBy("_t").rangeBetween(0, span)
    behind = Window.partitionBy(key, "_block").orderBy("_t").rangeBetween(-span, 0)
    starts = spread(times, -1).withColumn("_c", F.sum("_n").over(ahead)).filter("_block = _own").select(key, "_t", "_c")
    flagged = spread(starts, 1).withColumn("_most", F.max("_c").over(behind)).filter("_block = _own").filter(F.col("_most") > more_than).select(key, F.col("_t").alias("_m"))
    return _marked(rows.withColumn("_m", micros), flagged, [key, "_m"], [key, when], out).drop("_m")


def material(a: Column, b: Column, least: float, ratio: float) -> Column:
    """Numbers that differ by more than ``least`` and by at least ``ratio`` of the larger one."""
    d = F.abs(a - b)
    return (d > least) & (d / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) >= ratio)


def conflicts(a: DataFrame, b: DataFrame, key: str, numeric: list[str], categorical: list[str], least: float = 500.0, ratio: float = 0.01) -> DataFrame:
    """(key, field_name, value_a, value_b) where one row a key of each side disagree; missing values don't."""
    left = a.select(key, *(F.col(c).alias(f"_a_{c}") for c in numeric + categorical))
    right = b.select(key, *(F.col(c).alias(f"_b_{c}") for c in numeric + categorical))
    found = []
    for c in numeric + categorical:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        bad = material(x.cast("double"), y.cast("double"), least, ratio) if c in numeric else x != y
        found.append(F.when(bad, F.struct(F.lit(c).alias("field_name"), x.cast("string").alias("value_a"), y.cast("string").alias("value_b"))))
    both = left.join(right, key).select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
    return both.select(key, "x.*")


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the largest ``by`` of each key, by aggregation: hot keys are summed up where they are read."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*by)).alias("_x"))
    return packed.select(*keys, "_x.*").select(*rows.columns)


def source_conflicts(records: DataFrame, first: str = "OriginationCore", second: str = "ServicerFeed") -> DataFrame:
    """Exceptions where the latest records of two sources disagree: MEDIUM, not blocking, filed with the second."""
    mine = records.select("loan_id", "source_system", "version", "raw_record_id", "data.current_balance", "data.payment_status")
    top = latest(mine.filter(F.col("source_system").isin(first, second)), ["loan_id", "source_system"], ["version"])
    a, b = top.filter(F.col("source_system") == first), top.filter(F.col("source_system") == second)
    found = conflicts(a, b, "loan_id", ["current_balance"], ["payment_status"])
    return found.join(b.select("loan_id", "raw_record_id"), "loan_id").select(
        F.sha2(F.concat_ws("|", F.lit("source_conflict"), "loan_id", "field_name"), 256).alias("exception_id"),
        "loan_id",
        "raw_record_id",
        F.lit("source_conflict").alias("exception_type"),
        F.lit(None).cast("string").alias("rule_code"),
        "field_name",
        F.lit("MEDIUM").alias("severity"),
        F.lit(False).alias("is_blocking"),
        F.lit("open").alias("status"),
        "value_a",
        "value_b",
    )
