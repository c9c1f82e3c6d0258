"""Batches of decisions against full runs, minted versions and their chain."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tapewright.contracts import Rule, trust_table
from tapewright.operators import canonical, chain, edits, minting, resolve, trust, validate
from tapewright.operators.conditions import fields
from tapewright.plans.state_queries import _as_records

AT = "2026-08-28T12:00:00"
f = fields()
RULES = [Rule("BALANCE", "HIGH", "balance {current_balance}", f.current_balance >= 0), Rule("KIND", "LOW", "", f.property_type.in_set(["condo", "house"]))]
N = 20
FIELDS = ["current_balance", "property_type"]
POLICY = [("a", None, 60), ("b", None, 80), ("b", "property_type", 40), ("human_override", None, 100)]


@pytest.fixture(scope="module")
def state(spark):
    random.seed(4)
    rows = [(i, s, v, random.choice(["10.0"] * 6 + ["-5.0", None]), random.choice(["condo", "boat", None])) for i in range(1, N + 1) for s, v in (("a", 1), ("b", 1), ("b", 2))]
    records = _as_records(spark.createDataFrame(rows, "loan_id long, source_system string, version long, current_balance string, property_type string"))
    return edits.stored(full(spark, records, None, None))


def full(spark, records, pins, exceptions):
    """Everything computed anew from records and pins; ``exceptions`` as they stand, or those of the rules."""
    flat = records.select("loan_id", "source_system", "version", *(F.col(f"data.{c}").alias(c) for c in FIELDS))
    winners = canonical.blend(flat, trust_table(spark, POLICY), "loan_id", FIELDS, pins)
    results = validate.validate_records(records, RULES, AT, ("import", "human_edit"))
    if exceptions is None:
        found = validate.exceptions_of(results.withColumn("loan_id", F.col("loan_id").cast("long")), "raw_record_id")
        exceptions = found.unionByName(found.limit(1).withColumns({"exception_id": F.lit("stray"), "loan_id": F.lit(None).cast("long")})).withColumn("decision_id", F.lit(None).cast("string"))
    scores = trust.trust_scores(winners.select("loan_id").distinct(), "loan_id", results.select(F.col("loan_id").cast("long").alias("loan_id"), "severity", "result"), exceptions.filter("loan_id is not null"), winners)
    return edits.Standing(records, winners, results.withColumn("loan_id", F.col("loan_id").cast("long")), exceptions, scores)


@pytest.fixture(scope="module")
def decisions(spark, state):
    ids = sorted((r["loan_id"], r["exception_id"]) for r in state.exceptions.filter("loan_id is not null").collect())
    assert len(ids) > 12
    out, kinds = [], ["edit", "accept", "reject", "manual_resolution", "edit"]
    for i, (_, e) in enumerate(ids[:10]):
        change = [("current_balance", str(i - 4.5)), ("property_type", None if i % 2 else "boat")] if kinds[i % 5] in edits.EDITING else None
        out.append((f"d{i}", e, kinds[i % 5], 100 + i, change))
    out.append(("late", ids[0][1], "reject", 500, None))  # a second decision
    out.append(("twice", ids[11][1], "edit", 300, [("current_balance", "9"), ("current_balance", "10")]))
    out.append(("gone", "nowhere", "accept", 1, None))
    out.append(("odd", ids[10][1], "shrug", 1, None))
    out.append(("alone", "stray", "edit", 2, [("current_balance", "1")]))
    return spark.createDataFrame(out, "decision_id string, exception_id string, action string, decided_at long, changes array<struct<field_name:string,value:string>>")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_a_batch_equals_a_full_run(spark, state, decisions):
    done = edits.apply(state, decisions, RULES, AT)
    after = edits.stored(edits.merged(state, done.changed))
    again = full(spark, after.records, done.pins, after.exceptions)
    assert rows(after.winners, "loan_id", "field_name", "value", "source_system", "pinned") == rows(again.winners, "loan_id", "field_name", "value", "source_system", "pinned")
    assert rows(after.scores, "loan_id", "trust_score", "capped") == rows(again.scores, "loan_id", "trust_score", "capped")
    assert rows(after.results, "loan_id", "rule_code", "result", "message") == rows(again.results, "loan_id", "rule_code", "result", "message")
    status = {r["exception_id"]: (r["status"], r["decision_id"]) for r in after.exceptions.collect()}
    assert status["stray"] == ("resolved", "alone")
    assert {r["decision_id"]: r["reason"] for r in done.refused.collect()} == {"late": "already decided", "gone": "unknown exception", "odd": "unknown action"}
    # a bad edit opens an exception of its own
    fresh = [r for r in done.changed.exceptions.collect() if r["rule_code"] == "BALANCE" and r["raw_record_id"] is None]
    assert fresh and all(r["status"] == "open" and r["is_blocking"] for r in fresh)
    # loans without decisions have no changed row
    touched = {r["loan_id"] for r in done.audit.collect()} - {None}
    assert {r["loan_id"] for r in done.changed.scores.collect()} == touched
    twice = after.winners.filter("value = '10'").count()
    assert twice == 1


def test_the_log_holds_what_stood_before(spark, state, decisions):
    done = edits.apply(state, decisions, RULES, AT)
    told = {r["decision_id"]: (json.loads(r["before_value"]), json.loads(r["after_value"])) for r in done.audit.filter("event_type = 'field_edited'").collect()}
    stood = {(r["loan_id"], r["field_name"]): r["value"] for r in state.winners.collect()}
    loan = {r["exception_id"]: r["loan_id"] for r in state.exceptions.collect()}
    of = {r["decision_id"]: loan.get(r["exception_id"]) for r in decisions.collect()}
    for d in sorted(told, key=lambda d: {r["decision_id"]: r["decided_at"] for r in decisions.collect()}[d]):
        before, after = told[d]
        for c in after:
            assert before[c] == stood.get((of[d], c))
            stood[of[d], c] = after[c]


def test_edits_of_loans_without_a_canonical_row_are_refused(spark, state, decisions):
    none = edits.Standing(state.records, state.winners.limit(0), state.results, state.exceptions, state.scores)
    reasons = {r["decision_id"]: r["reason"] for r in edits.apply(none, decisions, RULES, AT).refused.collect()}
    assert reasons["d0"] == "no canonical record" and "d1" not in reasons


def test_two_values_at_once_end_the_job(spark):
    one = spark.createDataFrame([(1, "d", 5, "current_balance", "9"), (1, "d", 5, "current_balance", "10")], "loan_id long, decision_id string, decided_at long, field_name string, value string")
    with pytest.raises(Exception, match="two values at once"):
        resolve.human_records(one).collect()
    later = one.withColumn("decided_at", F.col("decided_at") + F.length("value"))
    assert [r["data"]["current_balance"] for r in resolve.human_records(later).collect()] == [10.0]


def test_versions_are_minted_once_and_forgery_is_found(spark, state, decisions):
    files = state.records.filter("loan_id < 9").select("loan_id", F.col("source_system").alias("file_id"), F.lit("h").alias("file_hash"))
    summary = minting.summaries(state.results, state.exceptions, files)
    kept = {r["loan_id"]: r for r in summary.collect()}
    assert [x["file_id"] for x in kept[1]["source_files"]] == ["a", "b"] and kept[N]["source_files"] == []
    assert sum(kept[1]["validation"][v] for v in minting.VERDICTS) == kept[1]["validation"]["total"] == 6
    snaps = minting.snapshots(state.winners, state.scores, summary)
    asked = spark.createDataFrame([(i,) for i in [*range(1, N + 1), 77]], "loan_id long")
    first, refused = minting.minted(snaps, state.exceptions, None, None, "ann", AT, asked)
    first = first.cache()
    reasons = {r["loan_id"]: r["reason"] for r in refused.collect()}
    assert reasons[77] == "no canonical record" and reasons and {r["loan_id"] for r in first.collect()} == set(range(1, N + 1)) - set(reasons)
    assert all("open blocking" in v for k, v in reasons.items() if k != 77)
    assert minting.minted(snaps, state.exceptions, first, None, "bob", AT)[0].count() == 0
    # what doesn't block is accepted in some of the verified loans
    mine = [r for r in state.exceptions.filter("not is_blocking").collect() if r["loan_id"] is not None and r["loan_id"] not in reasons][:3]
    accepted = spark.createDataFrame([(f"a{i}", r["exception_id"], "accept", i, None) for i, r in enumerate(mine)], decisions.schema)
    done = edits.apply(state, accepted, RULES, AT)
    after = edits.merged(state, done.changed)
    decided = accepted.join(after.exceptions.select("exception_id", "loan_id"), "exception_id").select("loan_id", "decision_id", "decided_at")
    second, _ = minting.minted(minting.snapshots(after.winners, after.scores, minting.summaries(after.results, after.exceptions, files)), after.exceptions, first, decided, "ann", AT)
    every = first.unionByName(second).cache()
    assert {r["loan_id"] for r in every.collect() if r["version"] == 2 and r["decision_ids"]} == {r["loan_id"] for r in mine} != set()
    assert minting.checked(every).filter("problem is not null").count() == 0
    forged = every.withColumn("trust_score", F.when(F.col("version") == 2, F.lit(99.0)).otherwise(F.col("trust_score")))
    assert {r["problem"] for r in minting.checked(forged).collect()} == {None, "hash mismatch"}
    cut = every.filter("version = 2")
    assert {r["problem"] for r in minting.checked(cut).collect()} <= {"broken link", None}


def test_changes_merge_into_snapshots_and_touch_few_buckets(spark, state, decisions, tmp_path):
    held = edits.tables(state, str(tmp_path))
    assert set(edits.merge_into(held, state).values()) == {1}
    few = decisions.filter("decision_id in ('d1', 'd2')")
    done = edits.apply(edits.read(held), few, RULES, AT)
    versions = edits.merge_into(held, edits.stored(done.changed))
    # accepted and rejected: no record, cell or result is new
    assert versions == {"records": 1, "winners": 1, "results": 1, "exceptions": 2, "scores": 2}
    old, new = held["exceptions"]._folders(1), held["exceptions"]._folders(2)
    assert 1 <= sum(old[b] != new[b] for b in old) <= 2
    want = edits.merged(state, done.changed)
    assert rows(edits.read(held).exceptions, "exception_id", "status") == rows(want.exceptions, "exception_id", "status")
    assert rows(edits.read(held).scores, "loan_id", "trust_score") == rows(want.scores, "loan_id", "trust_score")
    assert edits.apply(edits.read(held), few, RULES, AT).refused.count() == 2


def test_json_columns_share_one_python_step(spark):
    """All parts of a snapshot go through one step with one worker, not a step and a worker a part."""
    texts = spark.createDataFrame([('{"b":1,"a":[]}', '{"z":null,"c":{"y":2.5,"x":"é"}}', None)], "a string, b string, c string")
    out = texts.select(*(chain.canonical_text(F.col(c)).alias(c) for c in texts.columns))
    assert tuple(out.first()) == ('{"a":[],"b":1}', '{"c":{"x":"é","y":2.5},"z":null}', None)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
