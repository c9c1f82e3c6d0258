"""Comparing what rules found with what an oracle expects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(oracle: DataFrame, engine: DataFrame, keys: list[str], per: str) -> DataFrame:
    """Per ``per``: expected, found, matched (multisets by ``keys``), extra and missed.  Keys that only one side has count too."""
    a = oracle.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_oracle"))
    b = engine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_engine"))
    # nulls are keys like any other here
    condition = None
    right = b.select(*(F.col(k).alias(f"_{k}") for k in keys), "n_engine")
    for k in keys:
        c = a[k].eqNullSafe(right[f"_{k}"])
        condition = c if condition is None else condition & c
    both = a.join(right, condition, "full_outer").select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), F.coalesce("n_oracle", F.lit(0)).alias("n_oracle"), F.coalesce("n_engine", F.lit(0)).alias("n_engine"))
    hit = F.least("n_oracle", "n_engine")
    sums = both.groupBy(per).agg(F.sum("n_oracle").alias("oracle"), F.sum("n_engine").alias("engine"), F.sum(hit).alias("matched"))
    return sums.withColumn("extra", F.col("engine") - F.col("matched")).withColumn("missed", F.col("oracle") - F.col("matched"))


def reconciled(oracle: DataFrame, engine: DataFrame, keys: list[str], per: str, by_count: str = "^DUPLICATE_") -> DataFrame:
    """``matched`` with a status: ok, extra, missed or both.

    Rules whose name matches ``by_count`` are compared by counts only, as either of two
    duplicates may be the one that the oracle names.
    """
    exact = matched(oracle, engine, keys, per)
    counted = F.col(per).rlike(by_count)
    hit = F.when(counted, F.least("oracle", "engine")).otherwise(F.col("matched"))
    out = exact.withColumn("matched", hit).withColumn("extra", F.col("engine") - F.col("matched")).withColumn("missed", F.col("oracle") - F.col("matched"))
    status = F.when((F.col("extra") > 0) & (F.col("missed") > 0), "both").when(F.col("extra") > 0, "extra").when(F.col("missed") > 0, "missed").otherwise("ok")
    return out.withColumn("status", status)


def explained(extras: DataFrame, engine: DataFrame, injected: DataFrame, key: str) -> DataFrame:
    """Extras in buckets: on a record with an injected defect of another kind, a copy of such a record, or unexplained."""
    other = injected.select(key).distinct().withColumn("_co", F.lit(True))
    twice = engine.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.when(F.col("_co"), "co-triggered by the same defect").when(F.col("_n") > 1, "several findings on one record").otherwise("unexplained")
    return extras.join(other, key, "left").join(twice, key, "left").withColumn("bucket", bucket).drop("_co", "_n")


def recovered_sources(exceptions: DataFrame, rules: DataFrame, raw: DataFrame, files: DataFrame) -> DataFrame:
    """Validation failures by rule and kind of file; those without a raw row come from people's edits."""
    found = exceptions.filter("exception_type = 'validation_failure'").join(rules.select("rule_code").distinct(), "rule_code")
    placed = found.join(raw.select("raw_record_id", "raw_file_id"), "raw_record_id", "left").join(files.select("raw_file_id", "file_kind"), "raw_file_id", "left")
    return placed.groupBy("rule_code", F.coalesce("file_kind", F.lit("human_edit")).alias("src")).agg(F.count(F.lit(1)).alias("n"))


def conflict_keys(exceptions: DataFrame, loans: DataFrame) -> DataFrame:
    """Source conflicts by a loan's business id and field."""
    found = exceptions.filter("exception_type = 'source_conflict'").join(loans.select("loan_id", "business_id"), "loan_id")
    return found.groupBy("business_id", "field_name").agg(F.count(F.lit(1)).alias("n"))


def bad_numerics(exceptions: DataFrame, loans: DataFrame) -> DataFrame:
    """Loans of which a number can't be read, so that comparisons skip them."""
    return exceptions.filter("rule_code = 'INVALID_NUMERIC_FORMAT'").join(loans.select("loan_id", "business_id"), "loan_id").select("business_id").distinct()


def contract_gaps(codes: DataFrame, covered: DataFrame, column: str) -> DataFrame:
    """Codes that only one side has."""
    a, b = codes.select(column).distinct(), covered.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("missing_from", F.lit("oracle")).unionByName(b.join(a, column, "left_anti").withColumn("missing_from", F.lit("rules")))
