"""A verification run over a folder of state: files land once, and a stage runs if what it reads has changed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..operators import edits, resolve, trust, validate
from ..sources import landing_table, tapes
from ..sources.landing_table import LandingTable, Upload
from . import pipeline
from .ledger import Ledger, digest

Tables = dict[str, DataFrame]


def rules_digest(rules: list[contracts.Rule]) -> str:
    """Changes with the active rules' codes, versions, settings and conditions."""
    return digest(*sorted((r.code, r.version, r.severity, r.message, r.condition.to_json() if r.condition else r.check) for r in rules if r.active))


def verify_folder(
    spark: SparkSession, folder: str, uploads: list[Upload], rules: list[contracts.Rule], trust_rows: list[tuple[str, str | None, int]], at: dt.datetime | str, force: bool = False
) -> tuple[Tables, list[tuple[str, bool]]]:
    """(all tables of the run, which stages did work).

    A repeated run reads the ledger and does nothing else.  New files run through all stages;
    a changed rule leaves landing, records and blend as they are, a changed trust the
    validation.  ``force`` makes every stage anew; open exceptions are found again and those
    that were decided stay as they were decided (see ``decided``).
    """
    ledger = Ledger(spark, folder)
    raw = LandingTable(spark, f"{folder}/raw")
    ledger.log.append(("land", bool(raw.land(uploads))))
    files, by_rules, by_trust = raw.digest(), rules_digest(rules), digest(sorted(trust_rows, key=str))

    def records() -> Tables:
        found, errors = landing_table.records(raw)
        named = found.withColumn("loan_id", F.col("data.loan_id"))
        return {"records": tapes.versioned(named, ["loan_id", "source_system"], list(landing_table.ORDER)).withColumn("origin", F.lit("import")), "errors": errors}

    one = ledger.once("records", files, records, force)

    def results() -> Tables:
        return {"results": validate.validate_records(one["records"], rules, at), "dataset_results": _dataset(one["records"], rules)}

    checked_by = digest(files, by_rules, str(at))
    two = ledger.once("validate", checked_by, results, force)

    def exceptions() -> Tables:
        before = ledger.latest("exceptions")
        found = pipeline.exceptions_found(one["records"], two["results"], two["dataset_results"], one["errors"], before and before["exceptions"])
        marked, clusters = resolve.assign_clusters(found)
        return {"exceptions": marked, "clusters": resolve.carried(clusters, before and before["clusters"])}

    three = ledger.once("exceptions", checked_by, exceptions, force)
    pins = ledger.latest("pins")
    pinned = ledger.number_of("pins")

    def blend() -> Tables:
        policy = contracts.trust_table(spark, trust_rows)
        winners, _ = pipeline.blended(one["records"], policy, pins and pins["pins"])
        return {"winners": winners, "canonical": lambda done: pipeline.widened(done["winners"])}

    four = ledger.once("blend", digest(files, by_trust, pinned), blend, force)

    def scores() -> Tables:
        now = pipeline.scored(four["canonical"], two["results"], two["dataset_results"], three["exceptions"], four["winners"])
        return {"scores": now, "ready": trust.to_verify(four["canonical"], three["exceptions"], None, "loan_id")}

    five = ledger.once("score", digest(checked_by, by_trust, pinned, ledger.number_of("exceptions")), scores, force)
    return {**one, **two, **three, **four, **five}, ledger.log


def decided(spark: SparkSession, folder: str, decisions: DataFrame, rules: list[contracts.Rule], at: dt.datetime | str) -> edits.Applied:
    """Apply a batch of decisions (see ``edits.apply``) to the last run: exceptions, clusters and pins get a newer state.

    The next run keeps them: what was decided isn't found again, pins stand above all sources,
    and scores are taken anew.
    """
    ledger = Ledger(spark, folder)
    last = {stage: ledger.latest(stage) for stage in ("records", "validate", "exceptions", "blend", "score", "pins")}
    if last["score"] is None:
        raise ValueError("nothing has run yet")
    stood = last["exceptions"]["exceptions"]
    if "decision_id" not in stood.columns:
        stood = stood.withColumn("decision_id", F.lit(None).cast("string"))
    if "changes" not in decisions.columns:
        decisions = decisions.withColumn("changes", F.lit(None).cast("array<struct<field_name:string,value:string>>"))
    results = last["validate"]["results"]
    state = edits.Standing(last["records"]["records"], last["blend"]["winners"], results, stood, last["score"]["scores"])
    done = edits.apply(state, decisions, rules, at)
    changed = done.changed.exceptions
    moved = changed.join(stood.select("exception_id", F.col("status").alias("old_status"), F.col("cluster_id").alias("old_cluster_id")), "exception_id", "left")
    label = resolve.cluster_label(F.col("rule_code"), F.col("rule_version"), F.col("exception_type"))
    changed = changed.withColumn("cluster_id", F.coalesce("cluster_id", F.when(F.col("status") == "open", F.sha2(label, 256))))
    now = stood.join(changed.select("exception_id"), "exception_id", "left_anti").unionByName(changed)
    pins = done.pins if last["pins"] is None else done.pins.unionByName(last["pins"]["pins"].join(done.pins, ["loan_id", "field_name"], "left_anti"))
    inputs = ledger.digest_of("exceptions")
    ledger.once("exceptions", inputs, lambda: {"exceptions": now, "clusters": resolve.regrouped(last["exceptions"]["clusters"], moved)}, force=True)
    if not done.pins.isEmpty():
        ledger.once("pins", digest(inputs, ledger.number_of("pins")), lambda: {"pins": pins}, force=True)
    return done


def _dataset(records: DataFrame, rules: list[contracts.Rule]) -> DataFrame:
    out = validate.validate_dataset(records, rules)
    if out is None:  # no such rules
        out = validate.validate_dataset(records.limit(0), [contracts.Rule("NONE", "LOW", "", check={"check": "duplicate_key", "keys": ["loan_id"]})])
    return out
