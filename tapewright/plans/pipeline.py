"""The whole verification run: records in, results, exceptions, canonical rows and scores out."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..operators import canonical, detect, resolve, trust, validate
from ..sources import tapes


@dataclass
class Run:
    results: DataFrame
    dataset_results: DataFrame
    exceptions: DataFrame
    clusters: DataFrame
    winners: DataFrame
    canonical: DataFrame
    scores: DataFrame
    ready: DataFrame


def ingest(spark: SparkSession, path: str, kind: str, raw_file_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw rows, records, import errors) of one source file."""
    headers = tapes.headers_of(spark, path)
    mapping, _ = tapes.column_mapping(headers)
    raw = tapes.landed(tapes.read_lines(spark, path, headers), raw_file_id, kind, headers)
    records, errors = tapes.quarantined(tapes.normalised(raw, mapping))
    return raw, records, errors


def versioned_records(parts: list[DataFrame], base: DataFrame | None = None) -> DataFrame:
    """Records of several files, in the order of the files, with versions per loan and source."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("file_seq", F.lit(i)).withColumn("loan_id", F.col("data.loan_id"))
        both = p if both is None else both.unionByName(p)
    return tapes.versioned(both, ["loan_id", "source_system"], ["file_seq", "row_number"], base).withColumn("origin", F.lit("import"))


def _fields() -> list[str]:
    return [f for f in contracts.FIELD_TYPES if f not in ("source_system", "loan_id")]


def exceptions_found(records: DataFrame, results: DataFrame, dataset: DataFrame, import_errors: DataFrame | None, previous: DataFrame | None) -> DataFrame:
    """Exceptions of rules, dataset checks, conflicts and imports; what was decided in ``previous`` stays decided.

    Open exceptions that edits made stay too: they hang on no imported row, so no run finds them again.
    """
    edited = "exception_type = 'validation_failure' and raw_record_id is null"
    found = None if previous is None else previous.filter(f"status <> 'open' or {edited}")
    # a row rule's exception is decided by record, a dataset rule's by loan, a conflict's by loan and field
    kinds = (
        (validate.exceptions_of(results, "raw_record_id"), ["rule_code", "raw_record_id"]),
        (validate.exceptions_of(dataset, "loan_id"), ["rule_code", "loan_id"]),
        (detect.source_conflicts(records), ["exception_type", "loan_id", "field_name"]),
    )
    for fresh, keys in kinds:
        if previous is not None:
            fresh = fresh.join(previous.filter("status <> 'open'").select(*keys).distinct(), keys, "left_anti")
        found = fresh if found is None else found.unionByName(fresh, allowMissingColumns=True)
    if import_errors is not None:
        if previous is not None:
            import_errors = import_errors.join(previous.filter("status <> 'open'").select("exception_id"), "exception_id", "left_anti")
        found = found.unionByName(import_errors, allowMissingColumns=True)
    return found


def blended(records: DataFrame, trust_policy: DataFrame, pins: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(winners, canonical rows) of records."""
    flat = records.select("source_system", "version", F.col("raw_record_id").alias("record_id"), *(F.col(f"data.{f}").alias(f) for f in contracts.FIELD_TYPES if f != "source_system"))
    winners = canonical.blend(flat, trust_policy, "loan_id", _fields(), pins)
    return winners, widened(winners)


def widened(winners: DataFrame) -> DataFrame:
    """Canonical rows of winners."""
    return canonical.wide(winners, "loan_id", _fields())


def scored(rows: DataFrame, results: DataFrame, dataset: DataFrame, exceptions: DataFrame, winners: DataFrame) -> DataFrame:
    both = results.select("loan_id", "severity", "result").unionByName(dataset.select("loan_id", "severity", "result"))
    return trust.trust_scores(rows, "loan_id", both, exceptions.filter("loan_id is not null"), winners)


def verify(
    records: DataFrame, import_errors: DataFrame | None, trust_policy: DataFrame, at: dt.datetime | str, rules: list[contracts.Rule] | None = None,
    previous: DataFrame | None = None, pins: DataFrame | None = None, verified: DataFrame | None = None,
) -> Run:
    """All stages over versioned records.  ``previous`` exceptions keep their decisions."""
    rules = contracts.seed_rules() if rules is None else rules
    results = validate.validate_records(records, rules, at)
    dataset = validate.validate_dataset(records, rules)
    exceptions, clusters = resolve.assign_clusters(exceptions_found(records, results, dataset, import_errors, previous))
    winners, rows = blended(records, trust_policy, pins)
    scores = scored(rows, results, dataset, exceptions, winners)
    return Run(results, dataset, exceptions, clusters, winners, rows, scores, trust.to_verify(rows, exceptions, verified, "loan_id"))
