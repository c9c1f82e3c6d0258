"""Views, rule vocabulary and logs on small rows, order included."""

import pytest
from pyspark.sql import functions as F

from tapewright import contracts
from tapewright.operators import chain, resolve, validate
from tapewright.operators.conditions import Compiler, Condition, fields, plain
from tapewright.plans import views

f = fields()


@pytest.fixture(scope="module")
def queue(spark):
    rows = [("e1", "L1", "LOW", "open", "A", "validation_failure", False), ("e2", "L1", "CRITICAL", "open", "B", "validation_failure", True), ("e3", "L2", "HIGH", "resolved", "A", "validation_failure", True), ("e4", None, "HIGH", "open", None, "import_error", True), ("e5", "L3", "HIGH", "open", "A", "validation_failure", True)]
    return spark.createDataFrame(rows, "exception_id string, loan_id string, severity string, status string, rule_code string, exception_type string, is_blocking boolean").withColumn("rule_version", F.lit(1))


def test_the_queue_shows_the_worst_first(spark, queue):
    ids = lambda df: [r["exception_id"] for r in df.collect()]
    assert ids(views.exceptions_list(queue, status="open")) == ["e2", "e4", "e5", "e1"]
    loans = spark.createDataFrame([("L1", "b"), ("L2", "b"), ("L3", "c")], "loan_id string, borrower_id string")
    assert ids(views.exceptions_list(queue, loans, search="B")) == ["e2", "e3", "e1"]
    assert ids(views.exceptions_list(queue, blocking_only=True, severity="HIGH")) == ["e3", "e4", "e5"]
    second = views.paged(queue, [F.desc("exception_id")], 2, 2).collect()
    assert [(r["exception_id"], r["total_rows"], r["total_pages"]) for r in second] == [("e3", 5, 3), ("e2", 5, 3)]
    assert [r["exception_id"] for r in views.page(queue, ["exception_id"], -3, 0).collect()] == ["e1"]
    assert (views.page_count(0), views.page_count(201, 500), views.page_count(5, 2)) == (0, 2, 3)


def test_clusters_come_fullest_first_and_empty_ones_stay(spark, queue):
    marked, found = resolve.assign_clusters(queue)
    before = found.withColumn("member_count", F.lit(9).cast("long"))
    gone = spark.createDataFrame([("old", "GONE v1", 4)], found.select("cluster_id", "label", "member_count").schema)
    kept = resolve.carried(found.select("cluster_id", "label", "member_count"), before.select("cluster_id", "label", "member_count").unionByName(gone))
    assert {r["label"]: r["member_count"] for r in kept.collect()} == {"A v1": 2, "B v1": 1, "Import errors": 1, "GONE v1": 0}
    shown = views.clusters(kept, marked).collect()
    assert [(r["label"], r["open_count"], r["loans"], r["highest_severity"]) for r in shown] == [("A v1", 2, 2, "HIGH"), ("B v1", 1, 1, "CRITICAL"), ("Import errors", 1, 0, "HIGH"), ("GONE v1", 0, 0, None)]


def test_details_of_one_loan_and_one_exception(spark, queue):
    records = spark.createDataFrame([("L1", "a", 1), ("L1", "a", 2), ("L1", "b", 1), ("L2", "a", 1)], "loan_id string, source_system string, version int")
    results = spark.createDataFrame([("L1", "A", "pass", 1), ("L1", "A", "fail", 2), ("L2", "A", "pass", 3)], "loan_id string, rule_code string, result string, evaluated_at int")
    verified = spark.createDataFrame([("L1", 1), ("L1", 2)], "loan_id string, version int")
    page = views.loan_detail("L1", records, queue, results, verified)
    assert sorted((r["source_system"], r["version"]) for r in page["records"].collect()) == [("a", 2), ("b", 1)]
    assert (page["validation"].first()["pass"], page["validation"].first()["fail"]) == (1, 1)
    assert [r["version"] for r in page["verified"].collect()] == [2, 1] and page["exceptions"].count() == 2
    said = spark.createDataFrame([("e1",), ("e1",), ("e2",)], "exception_id string")
    one = views.exception_detail("e1", queue, results, said)
    row = one["exception"].first()
    assert (row["result"]["result"], row["recommendations"], one["recommendations"].count()) == ("fail", 2, 2)
    assert views.exception_detail("e4", queue, results, said)["exception"].first()["result"] is None


def test_timelines_order_ties_by_kind_and_name(spark):
    a = spark.createDataFrame([("L", "z", 1), ("L", "y", 2)], "loan_id string, ref string, t int")
    b = spark.createDataFrame([("L", "b", 1), ("M", "m", 9)], "loan_id string, ref string, t int")
    assert [r["ref"] for r in views.timeline(("a", a.filter("loan_id = 'L'"), "t"), ("b", b.filter("loan_id = 'L'"), "t")).collect()] == ["z", "b", "y"]
    places = {(r["loan_id"], r["ref"]): r["place"] for r in views.timelines("loan_id", ("a", a, "t"), ("b", b, "t")).collect()}
    assert places == {("L", "z"): 1, ("L", "b"): 2, ("L", "y"): 3, ("M", "m"): 1}


def test_audit_bounds_and_order(spark):
    events = spark.createDataFrame([(i, "field_edited", "L1" if i % 2 else "L2") for i in range(1, 7)], "seq long, event_type string, loan_key string")
    seqs = lambda **k: [r["seq"] for r in views.audit_events(events, **k).collect()]
    assert seqs(from_seq="2", to_seq=4) == [2, 3, 4]
    assert seqs(from_seq="soon", to_seq=" 3 ") == [1, 2, 3]
    assert seqs(loan_key="L1") == [5, 3, 1] and seqs(event_type="other") == []
    named = events.withColumn("actor_type", F.lit("human"))
    assert chain.unknown_events(named).count() == 0 and chain.unknown_events(named.withColumn("actor_type", F.lit("ghost"))).count() == 6
    with pytest.raises(Exception, match="unknown event type"):
        chain.appended(named.withColumn("event_type", F.lit("dance")), ["loan_key"], ["seq"], ["event_type", "actor_type"]).collect()


def test_rules_are_published_as_versions_and_switched(spark):
    rule = contracts.Rule("A", "LOW", "", f.x.given(), source="manual")
    rules = contracts.publish(contracts.publish([], rule), rule)
    assert [(r.code, r.version, r.active) for r in rules] == [("A", 1, True), ("A", 2, True)]
    off = contracts.set_active(rules, "A", 1, False)
    assert [r.active for r in off] == [False, True]
    for code, version, active in (("A", 1, False), ("B", 1, True)):
        with pytest.raises(ValueError, match="nothing to change"):
            contracts.set_active(off, code, version, active)
    with pytest.raises(ValueError, match="severity or source"):
        contracts.publish([], contracts.Rule("A", "GRAVE", "", f.x.given()))
    assert [(r["rule_code"], r["version"]) for r in contracts.rules_table(spark, [*rules, contracts.Rule("0", "LOW", "", f.x.given())]).collect()] == [("A", 2), ("0", 1), ("A", 1)]


@pytest.mark.parametrize(
    "node", [{"type": "spell"}, {"type": "func", "name": "rhyme", "args": []}, {"type": "comparison", "operator": "~", "left": {"type": "literal", "value": 1}, "right": {"type": "literal", "value": 1}}, {"type": "func", "name": "field_error", "args": [{"type": "literal", "value": 1}]}]
)
def test_unknown_nodes_are_refused_when_compiled(spark, node):
    rows = spark.range(1)
    with pytest.raises((ValueError, KeyError)):
        Compiler(plain(rows, "2024-01-01T00:00:00")).compile(node)


def test_a_tally_is_the_count_of_results(spark):
    rows = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None)], "x double, y string")
    rules = [contracts.Rule("X", "LOW", "", f.x > 2), contracts.Rule("Y", "LOW", "", f.y.in_set(["a"])), contracts.Rule("OFF", "LOW", "", f.x > 2, active=False)]
    binding = plain(rows, "2024-01-01T00:00:00")
    slow = validate.tally(validate.run_rules(rows, rules, binding, []))
    assert sorted(map(tuple, validate.tallied(rows, rules, binding).collect())) == sorted(map(tuple, slow.collect()))
    verdicts = validate.run_rules(rows, rules, binding, [], tells=validate.VERDICT)
    assert verdicts.columns == ["rule_code", "rule_version", "severity", "result"]
    full = validate.run_rules(rows, [contracts.Rule("M", "LOW", "", Condition({"type": "not", "operand": f.x.malformed().node}))], binding, [], tells=validate.DETAILS)
    assert full.select("field_errors", "out_of_scope").first() == ({}, [])


def test_results_of_an_active_rule_mean_that_it_ran(spark):
    rules = [contracts.Rule("A", "LOW", "", f.x.given()), contracts.Rule("B", "LOW", "", f.x.given(), active=False)]
    results = spark.createDataFrame([("B",), ("C",)], "rule_code string")
    assert not validate.already_run(None, rules) and not validate.already_run(results, rules)
    assert validate.already_run(results.union(spark.createDataFrame([("A",)], "rule_code string")), rules)
