"""Review decisions that take effect: a batch is applied to the standing tables.

Only what a batch touches is computed anew: edited cells are pinned, edits become records
that the rules run on, and the scores of loans with a decision are taken again from their own
rows.  The result equals a full run over all records, pins and decisions.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import BLOCKING, HUMAN, Rule
from ..sources.shared import written
from ..sources.snapshots import Snapshots
from . import resolve, trust, validate

EDITING = ("edit", "manual_resolution")
APPROVING = ("accept", "edit")
#: Trust of a pin.
PINNED = 100


@dataclass
class Standing:
    """Tables as they stand; every one has a loan_id.

    ``records``: as ``validate.validate_records`` takes them.  ``winners``: loan_id, field_name,
    value, source_system, trust, pinned, and more as ``canonical.blend`` gives them.
    ``results``: as the rules give them.  ``exceptions``: exception_id, loan_id, rule_code,
    rule_version, exception_type, field_name, severity, is_blocking, status, and more.  ``scores``: as
    ``trust.trust_scores`` gives them.
    """

    records: DataFrame
    winners: DataFrame
    results: DataFrame
    exceptions: DataFrame
    scores: DataFrame


#: Which rows of a table a changed row replaces.
KEYS = {"winners": ["loan_id", "field_name"], "exceptions": ["exception_id"], "scores": ["loan_id"]}


@dataclass
class Applied:
    """``changed``: rows that are new or replace others by ``KEYS``; ``refused``: decisions without effect, with the reason."""

    changed: Standing
    pins: DataFrame
    audit: DataFrame
    refused: DataFrame


def merged(state: Standing, changed: Standing) -> Standing:
    """The standing tables with the changed rows in the place of the old ones."""
    out = {}
    for name in (f.name for f in fields(Standing)):
        old, new = getattr(state, name), getattr(changed, name)
        if name in KEYS:
            old = old.join(new.select(*KEYS[name]), KEYS[name], "left_anti")
        out[name] = old.unionByName(new, allowMissingColumns=True)
    return Standing(**out)


#: What names a row of each table.
NAMED_BY = {"records": ["loan_id", "source_system", "version"], "winners": ["loan_id", "field_name"], "results": ["loan_id", "raw_record_id", "rule_code", "rule_version", "version"], "exceptions": ["exception_id"], "scores": ["loan_id"]}


def tables(state: Standing, path: str, buckets: int = 8) -> dict[str, Snapshots]:
    """Snapshot tables under ``path`` for tables like those of ``state``, to be read and merged into."""
    out = {}
    for name in (f.name for f in fields(Standing)):
        df = getattr(state, name)
        schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        out[name] = Snapshots(df.sparkSession, f"{path}/{name}", [c for c in NAMED_BY[name] if c in df.columns], schema, buckets)
    return out


def merge_into(held: dict[str, Snapshots], changed: Standing) -> dict[str, int]:
    """Changed rows into the snapshot tables: buckets without a touched loan keep their files.  The versions that then hold.

    Each table is swapped by itself, scores last; a run killed in between is repeated by
    merging the same changes again, which changes nothing where they are in already.
    """
    return {f.name: held[f.name].merge(getattr(changed, f.name)) for f in fields(Standing)}


def read(held: dict[str, Snapshots]) -> Standing:
    return Standing(**{name: table.read() for name, table in held.items()})


def stored(state: Standing, name: str = "standing") -> Standing:
    """The tables written and read again: what comes next starts from them."""
    return Standing(**{f.name: written(getattr(state, f.name), f"{name}-{f.name}") for f in fields(Standing)})


def taken(exceptions: DataFrame, winners: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions that take effect, with their exception's loan_id and old_status; refused ones with a reason).

    An exception takes its first decision, and none if it was decided before.  Edits need a
    canonical row of the loan; edits of exceptions without a loan change nothing but the status.
    """
    known = exceptions.select("exception_id", "loan_id", F.col("status").alias("old_status"))
    first = F.row_number().over(Window.partitionBy("exception_id").orderBy("decided_at", "decision_id"))
    asked = decisions.withColumn("_nth", first).join(known, "exception_id", "left")
    edits = F.col("action").isin(*EDITING) & F.col("loan_id").isNotNull() & (F.coalesce(F.size("changes"), F.lit(0)) > 0)
    loans = winners.select("loan_id").join(asked.filter(edits).select("loan_id"), "loan_id", "left_semi").distinct().withColumn("_there", F.lit(True))
    asked = asked.join(loans, "loan_id", "left")
    reason = (
        F.when(F.col("old_status").isNull(), "unknown exception")
        .when(~F.col("old_status").isin("open", "in_review") | (F.col("_nth") > 1), "already decided")
        .when(~F.col("action").isin(*resolve.ACCEPTING, "reject"), "unknown action")
        .when(edits & F.col("_there").isNull(), "no canonical record")
    )
    judged = asked.withColumn("reason", reason).withColumn("edits", edits).drop("_nth", "_there")
    # small, and read for every table
    judged = written(judged, "decisions")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").select("decision_id", "exception_id", "reason")


def apply(state: Standing, decisions: DataFrame, rules: list[Rule], at: dt.datetime | str, sources: int = trust.N_SOURCES) -> Applied:
    """The changes that ``decisions`` make.

    ``decisions``: decision_id, exception_id, action, decided_at and ``changes``, an array of
    (field_name, value as text).  Of several changes of a field the later one in the list
    counts, and over decisions the later decision.  ``at`` is the clock of the rules.
    """
    effective, refused = taken(state.exceptions, state.winners, decisions)
    edits = effective.filter("edits").select("loan_id", "decision_id", "exception_id", "action", "decided_at", F.posexplode("changes").alias("position", "_c")).select("*", "_c.field_name", "_c.value").drop("_c")
    order = F.struct("decided_at", "decision_id", "position")
    one = edits.groupBy("loan_id", "decision_id", "exception_id", "action", "decided_at", "field_name").agg(F.max_by("value", "position").alias("value"))
    touched = effective.filter("loan_id is not null").select("loan_id").distinct()
    of = lambda df: df.join(touched, "loan_id", "left_semi")

    pins = edits.groupBy("loan_id", "field_name").agg(F.max_by("value", order).alias("value"))
    cells = pins.select("loan_id", "field_name", "value", F.lit(HUMAN).alias("source_system"), F.lit(PINNED).alias("trust"), F.lit(True).alias("pinned"))
    before = of(state.winners)
    winners = _as(cells, state.winners)

    mine = written(resolve.human_records(edits.select("loan_id", "decision_id", "decided_at", "field_name", "value", "position"), of(state.records)), "edited")
    records = _as(mine, state.records)
    judged = written(validate.validate_records(mine, rules, at, ("human_edit",)), "judged")
    results = _as(judged, state.results)

    opened = judged.filter("result = 'fail'").select(
        F.sha2(F.concat_ws("|", F.lit("human_edit_revalidation"), "rule_code", F.col("rule_version").cast("string"), F.col("loan_id").cast("string"), F.col("version").cast("string")), 256).alias("exception_id"),
        "loan_id", F.lit("validation_failure").alias("exception_type"), "rule_code", "rule_version", "field_name", "severity", F.col("severity").isin(*BLOCKING).alias("is_blocking"), F.lit("open").alias("status"), "message",
    )
    status = F.when(F.col("action") == "reject", "rejected").otherwise("resolved")
    said = effective.select("exception_id", status.alias("_status"), *([F.col("decision_id").alias("_decision")] if "decision_id" in state.exceptions.columns else []))
    decided = state.exceptions.join(said, "exception_id").withColumn("status", F.col("_status"))
    if "decision_id" in state.exceptions.columns:
        decided = decided.withColumn("decision_id", F.col("_decision"))
    exceptions = decided.select(*state.exceptions.columns).unionByName(_as(opened, state.exceptions))

    now = merged(Standing(of(state.records), before, of(state.results), of(state.exceptions), of(state.scores)), Standing(records, winners, results, exceptions, of(state.scores).limit(0)))
    scores = trust.trust_scores(now.winners.select("loan_id").distinct(), "loan_id", now.results.select("loan_id", "severity", "result"), now.exceptions.filter("loan_id is not null"), now.winners, sources)
    return Applied(Standing(records, winners, results, exceptions, scores), pins, _audit(effective, one, before), refused)


def _as(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns and types of ``like``; what they lack is null."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t.dataType.simpleString()).alias(c) for c, t in zip(like.columns, like.schema, strict=True)))


def _audit(effective: DataFrame, edits: DataFrame, winners: DataFrame) -> DataFrame:
    """field_edited with the values that stood before each edit, and the decision itself.

    What an earlier decision of the batch set is what stood before a later one.
    """
    by_cell = Window.partitionBy("loan_id", "field_name").orderBy("decided_at", "decision_id")
    stood = winners.select("loan_id", "field_name", F.col("value").alias("_stood"))
    chained = edits.withColumn("_earlier", F.lag(F.struct("value")).over(by_cell)).join(stood, ["loan_id", "field_name"], "left")
    chained = chained.withColumn("before", F.when(F.col("_earlier").isNotNull(), F.col("_earlier.value")).otherwise(F.col("_stood")))
    told = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("field_name").alias("key"), F.col(c).alias("value"))))), {"ignoreNullFields": "false"})
    changed = chained.groupBy("loan_id", "decision_id", "exception_id", "action", "decided_at").agg(told("before").alias("before_value"), told("value").alias("after_value"))
    edited = changed.select(
        F.lit("field_edited").alias("event_type"), F.lit("loan_canonical").alias("entity_type"), F.col("loan_id").cast("string").alias("entity_id"), "loan_id", "before_value", "after_value",
        F.concat(F.lit("reviewer decision: "), "action", F.lit(" on exception "), F.col("exception_id").cast("string")).alias("reason"), "decided_at", "decision_id",
    )
    new = F.when(F.col("action") == "reject", "rejected").otherwise("resolved")
    decision = effective.select(
        F.when(F.col("action").isin(*APPROVING), "loan_approved").otherwise("loan_rejected").alias("event_type"), F.lit("exception").alias("entity_type"), F.col("exception_id").cast("string").alias("entity_id"), "loan_id",
        F.lit(None).cast("string").alias("before_value"), F.to_json(F.struct("action", "old_status", new.alias("new_status"), F.coalesce(F.size("changes"), F.lit(0)).alias("changes_count"))).alias("after_value"),
        F.concat(F.lit("reviewer resolved exception: "), "action").alias("reason"), "decided_at", "decision_id",
    )
    return edited.unionByName(decision)
