"""Review assistance as columns: confidence, suggestions, severity, texts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .english import HIGH_IMPACT
from .resolve import severity_rank

# --- fixed values ------------------------------------------------------------------
IDENTITY = ("loan_id", "borrower_id")
TYPE_FACTOR = {"source_conflict": 0.13, "duplicate": 0.11, "staleness": 0.09, "validation_failure": 0.07, "import_error": 0.04}
SEVERITY_FACTOR = {"LOW": 0.02, "MEDIUM": 0.03, "HIGH": 0.05, "CRITICAL": 0.07}
BASE, OTHER_TYPE, OTHER_SEVERITY = 0.25, 0.06, 0.03
IMPACT, NO_IMPACT = 0.10, 0.04
EVIDENCE = {2: 0.22, 1: 0.11, 0: 0.03}
COMPLETE_CANONICAL, COMPLETE_SOURCE = 0.10, 0.05
CLUSTER_CONFIDENCE = 0.85
# -------------------------------------------------------------------------------------


def _of(values: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(other))


def confidence(exception_type: Column, severity: Column, field: Column, n_sources: Column, canonical_known: Column, source_known: Column) -> Column:
    """How sure a recommendation is, from 0 to 1 with three decimals."""
    impact = F.when(field.isin(*HIGH_IMPACT), IMPACT).otherwise(NO_IMPACT)
    evidence = F.when(n_sources >= 2, EVIDENCE[2]).when(n_sources == 1, EVIDENCE[1]).otherwise(EVIDENCE[0])
    complete = F.when(canonical_known, COMPLETE_CANONICAL).otherwise(0.0) + F.when(source_known, COMPLETE_SOURCE).otherwise(0.0)
    total = F.lit(BASE) + _of(TYPE_FACTOR, exception_type, OTHER_TYPE) + _of(SEVERITY_FACTOR, severity, OTHER_SEVERITY) + impact + evidence + complete
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)


def reclassified(severity: Column, field: Column) -> Column:
    """HIGH and CRITICAL ease by one level for fields that are neither material nor identities; MEDIUM at least."""
    keeps = field.isNull() | field.isin(*HIGH_IMPACT) | field.isin(*IDENTITY)
    return F.when(keeps, severity).when(severity == "CRITICAL", "HIGH").when(severity == "HIGH", "MEDIUM").otherwise(severity)


def suggestions(exceptions: DataFrame, candidates: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """exception_id, suggested_value and suggested_source.

    ``candidates`` (key, field_name, source_system, version, value, trust) are all versions.
    A conflict of two candidates or more, and any other kind of exception, takes the most
    trusted value; a failed rule takes the first one, by source and version, that differs
    from the canonical value, or none.
    """
    order = F.struct("source_system", "version")
    options = exceptions.select("exception_id", "exception_type", key, "field_name").join(candidates, [key, "field_name"])
    options = options.join(canonical.select(key, "field_name", F.col("value").alias("_now")), [key, "field_name"], "left")
    failed = F.col("exception_type") == "validation_failure"
    differs = failed & (F.col("_now").isNull() | (F.col("value") != F.col("_now")))
    rank = F.struct(F.when(failed, 0).otherwise(-F.col("trust")).alias("t"), order.alias("o"))
    picked = options.filter(~failed | differs).groupBy("exception_id").agg(F.min_by(F.struct("value", "source_system"), rank).alias("x"))
    return picked.select("exception_id", F.col("x.value").alias("suggested_value"), F.col("x.source_system").alias("suggested_source"))


def evidence(candidates: DataFrame, key: str) -> DataFrame:
    """The last version's value of each source, as a map by source, for each field."""
    last = candidates.groupBy(key, "field_name", "source_system").agg(F.max_by("value", "version").alias("value"))
    return last.groupBy(key, "field_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_system", "value")))).alias("evidence"))


def is_dataset_rule(rule_code: Column, field: Column) -> Column:
    return field.isNull() & (rule_code.startswith("DUPLICATE_") | rule_code.startswith("REPEATED_"))


def problem(rule_code: Column, field: Column, exception_type: Column) -> Column:
    """One sentence on what is wrong."""
    whole = F.concat(F.lit("The check over the whole table '"), rule_code, F.lit("' flagged this record; no single field is at fault."))
    one = F.concat(F.lit("Field '"), F.coalesce(field, F.lit("unknown")), F.lit("' has a problem of kind "), exception_type, F.lit("."))
    return F.when(is_dataset_rule(rule_code, field), whole).otherwise(one)


def reasoning(rule_code: Column, field: Column, exception_type: Column, current: Column, suggested: Column, source: Column, sure: Column) -> Column:
    """Why a value is suggested, or why none is."""
    what = (
        F.when(is_dataset_rule(rule_code, field), F.concat(F.lit("Check over the whole table ("), rule_code, F.lit("): there is no single field to correct.")))
        .when(exception_type == "source_conflict", F.concat(F.lit("Sources disagree on '"), field, F.lit("'.")))
        .when(exception_type == "staleness", F.concat(F.lit("'"), field, F.lit("' may be stale.")))
        .when(exception_type == "duplicate", F.lit("Another loan has the same borrower fingerprint."))
        .otherwise(F.concat(F.lit("'"), F.coalesce(field, F.lit("unknown")), F.lit("' failed rule '"), F.coalesce(rule_code, F.lit("unknown")), F.lit("'.")))
    )
    now = F.when(~is_dataset_rule(rule_code, field) | rule_code.isNull(), F.concat(F.lit("Canonical value: "), F.coalesce(current, F.lit("N/A")), F.lit(".")))
    offer = F.when(suggested.isNotNull(), F.concat(F.lit("Suggested: "), suggested, F.coalesce(F.concat(F.lit(" from "), source), F.lit("")), F.lit("."))).when(
        exception_type == "validation_failure", F.lit("No source offers another value; correct it by hand.")
    )
    return F.concat_ws(" ", what, now, offer, F.concat(F.lit("Confidence "), F.format_number(sure * 100, 0), F.lit("%.")))


def reviewer_note(exception_type: Column, rule_code: Column, field: Column, severity: Column, status: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("["), severity, F.lit("]")), exception_type, F.coalesce(rule_code, F.lit("no rule")), F.concat(F.lit("on "), F.coalesce(field, F.lit("the record"))), F.concat(F.lit("("), status, F.lit(")")))


def cluster_summaries(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Per cluster: members, distinct loans, the commonest type and severity (ties by name), fields, and a sentence."""
    counted = lambda c: members.groupBy(key, c).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.min_by(c, F.struct((-F.col("_n")).alias("n"), F.col(c).alias("c"))).alias(f"top_{c}"))
    base = members.groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), F.count_distinct("loan_id").alias("n_loans"), F.array_sort(F.collect_set("field_name")).alias("fields"))
    both = base.join(counted("exception_type"), key).join(counted("severity"), key)
    text = F.concat(F.col("n_members").cast("string"), F.lit(" exceptions on "), F.col("n_loans").cast("string"), F.lit(" loans, mostly "), "top_exception_type", F.lit(" of severity "), "top_severity", F.lit("."))
    return both.withColumn("summary", text).withColumn("confidence", F.lit(CLUSTER_CONFIDENCE))


def newest_usable(recommendations: DataFrame) -> DataFrame:
    """Of each exception the newest recommendation that proposes a value for a field; ties to the larger recommendation_id."""
    usable = recommendations.filter("suggested_field <> '' and suggested_value <> ''")
    newest = F.max_by(F.struct(*recommendations.columns), F.struct("created_at", "recommendation_id")).alias("x")
    return usable.groupBy("exception_id").agg(newest).select("x.*")


def newest_recommendation(recommendations: DataFrame) -> DataFrame:
    """The newest recommendation of each kind for an exception, and how many came before it."""
    from .canonical import newest_versions

    n = recommendations.groupBy("exception_id", "action_type").agg((F.count(F.lit(1)) - 1).alias("earlier_runs"))
    return newest_versions(recommendations, ["exception_id", "action_type"], "created_at").join(n, ["exception_id", "action_type"])

