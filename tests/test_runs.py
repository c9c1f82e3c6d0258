"""Landing, configuration and runs that are killed, repeated and forced."""

import json

import pytest
from pyspark.sql import functions as F

from tapewright import contracts
from tapewright.operators.conditions import fields
from tapewright.plans import ledger as ledger_module
from tapewright.plans import runs
from tapewright.plans.ledger import Ledger, digest
from tapewright.sources import config, landing_table
from tapewright.sources.landing_table import LandingTable, Upload
from tapewright.sources.snapshots import Snapshots

AT = "2026-08-28T12:00:00"
f = fields()
RULES = [contracts.Rule("PRINCIPAL", "CRITICAL", "principal {original_principal}", f.original_principal >= 0)]
POLICY = [("OriginationCore", None, 60), ("ServicerFeed", None, 80)]


@pytest.fixture
def tapes_of(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return write


def rows(table):
    return sorted((r.raw_file_id[:4], r.row_number, r.parse_error, tuple(sorted(r.payload.items(), key=str))) for r in table.rows().collect())


@pytest.mark.parametrize("killed", ["renamed", "put_text"])
def test_a_killed_run_repeated_leaves_each_row_once(spark, tmp_path, tapes_of, monkeypatch, killed):
    uploads = [Upload(tapes_of("a.csv", "﻿loan_id,original_principal\nL1,5\n\nL2,\n"), "loan_tape"), Upload(tapes_of("b.csv", "loan_id,original_principal\nL3,7\n"), "loan_tape"), Upload(tapes_of("c.csv", "loan_id\nL1\n"), "document_manifest")]
    table = LandingTable(spark, str(tmp_path / "raw"))
    whole = getattr(landing_table, killed)
    monkeypatch.setattr(landing_table, killed, lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        table.land(uploads)
    assert table.rows().count() == 0 and table.manifest().count() == 0
    monkeypatch.setattr(landing_table, killed, whole)
    assert len(table.land(uploads)) == 3
    once = rows(table)
    assert len(once) == 4 and {r[2] for r in once} == {None}
    assert table.land(uploads) == [] and rows(table) == once
    counted = {r.file_name: (r.row_count, r.parsed_count, r.failed_count, r.source_system, r.batch_no, r.file_no) for r in table.manifest().collect()}
    assert counted == {"a.csv": (2, 2, 0, "OriginationCore", 1, 0), "b.csv": (1, 1, 0, "OriginationCore", 1, 1), "c.csv": (1, 1, 0, contracts.FILE_SOURCES["document_manifest"], 1, 2)}


def test_equal_contents_land_once_unless_forced(spark, tmp_path, tapes_of):
    one, two, other = (Upload(tapes_of(n, t), "loan_tape") for n, t in (("a.csv", "loan_id\nL1\n"), ("copy.csv", "loan_id\nL1\n"), ("other.csv", "loan_id\nL2\n")))
    table = LandingTable(spark, str(tmp_path / "raw"))
    assert [x["file_name"] for x in table.land([one, two])] == ["a.csv"]
    before = table.digest()
    assert table.land([two]) == [] and table.digest() == before
    assert [x["raw_file_id"][-2:] for x in table.land([two], force=True)] == ["-1"]
    assert [x["file_name"] for x in table.land([one, other])] == ["other.csv"] and table.digest() != before
    assert sorted(r.payload["loan_id"] for r in table.rows().collect()) == ["L1", "L1", "L2"]
    with pytest.raises(ValueError, match="unknown file kind"):
        table.land([Upload(one.path, "letter")])
    named = Upload(tapes_of("n.csv", "loan_id\nL9\n"), "loan_tape", "mine")
    assert table.land([named])[0]["raw_file_id"] == "mine"
    with pytest.raises(ValueError, match="under this id"):
        table.land([Upload(tapes_of("m.csv", "loan_id\nL8\n"), "loan_tape", "mine")])


def test_ragged_rows_land_with_their_errors(spark, tmp_path, tapes_of):
    text = 'loan_id,borrower_name,servicer_name\nL1,"a, ""b""\nc",\nL2\nL3,x,y,z,"p,q"\n'
    table = LandingTable(spark, str(tmp_path / "raw"))
    told = table.land([Upload(tapes_of("r.csv", text), "loan_tape")])[0]
    assert (told["row_count"], told["parsed_count"], told["failed_count"]) == (3, 1, 2)
    got = {r.row_number: r for r in table.rows().collect()}
    assert got[1].payload == {"loan_id": "L1", "borrower_name": 'a, "b"\nc', "servicer_name": ""}
    assert [got[n].parse_error for n in (1, 2, 3)] == [None, "missing column(s): borrower_name,servicer_name", "2 extra column(s) beyond header"]


def test_snapshots_merge_by_key_and_swap_at_once(spark, tmp_path, monkeypatch):
    table = Snapshots(spark, str(tmp_path / "s"), ["a", "b"], "a string, b string, n int", 4)
    row = lambda *r: spark.createDataFrame(list(r), "a string, b string, n int")
    assert table.version() == 0 and table.read().count() == 0
    assert table.merge(row(("x", None, 1), ("y", "k", 2), ("z", None, None))) == 1
    assert table.merge(row(("x", None, 1), ("z", None, None))) == 1  # nothing new
    assert table.merge(row(("x", None, 5))) == 2
    read = lambda v=None: sorted((tuple(r) for r in table.read(v).collect()), key=str)
    assert read() == sorted([("x", None, 5), ("y", "k", 2), ("z", None, None)], key=str) and ("x", None, 1) in read(1)
    # buckets without a change keep their files
    old, new = table._folders(1), table._folders(2)
    assert sum(old[b] != new[b] for b in old) == 1
    with pytest.raises(ValueError, match="several changes"):
        table.merge(row(("q", "1", 1), ("q", "1", 2)))
    assert table.version() == 2
    late = row(("q", "1", 1), ("q", "1", 2)).withColumn("at", F.col("n"))
    assert table.merge(late, order="at") == 3 and ("q", "1", 2) in read()
    from tapewright.sources import snapshots

    monkeypatch.setattr(snapshots, "put_text", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        table.merge(row(("x", None, 9)))
    assert table.version() == 3 and ("x", None, 5) in read()


def test_configuration_merges_by_natural_key(spark, tmp_path):
    rules = [
        {"rule_code": "A", "scope": "row", "severity": "LOW", "message_template": "m {x}", "condition": f.current_balance.given().node},
        {"rule_code": "D", "version": 2, "scope": "dataset", "severity": "HIGH", "message_template": "d", "explanation": "why", "condition": {"check": "duplicate_key", "keys": ["loan_id"]}},
    ]
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    table = config.rules_table(spark, str(tmp_path / "rules"))
    assert (config.load_rules(table, str(path)), config.load_rules(table, str(path))) == (1, 1)
    got = config.rules_of(table.read())
    assert [(r.code, r.version, r.scope, r.severity) for r in got] == [("A", 1, "row", "LOW"), ("D", 2, "dataset", "HIGH")]
    assert got[0].condition.node == rules[0]["condition"] and got[1].check == rules[1]["condition"]
    path.write_text(json.dumps([rules[0] | {"severity": "HIGH"}, rules[0] | {"version": 2}]))
    assert config.load_rules(table, str(path)) == 2
    assert [(r.code, r.version, r.severity) for r in config.rules_of(table.read())] == [("A", 1, "HIGH"), ("A", 2, "LOW"), ("D", 2, "HIGH")]
    path.write_text(json.dumps([rules[0] | {"severity": "GRAVE"}]))
    with pytest.raises(ValueError, match="unknown scope or severity"):
        config.load_rules(table, str(path))
    trust, file = config.trust_table(spark, str(tmp_path / "trust")), tmp_path / "trust.json"
    file.write_text(json.dumps([{"source_system": "S", "field_name": None, "trust_score": 60, "rationale": "r"}, {"source_system": "S", "field_name": "ltv_ratio", "trust_score": 70, "rationale": "r"}]))
    config.load_trust(trust, str(file))
    file.write_text(json.dumps([{"source_system": "S", "field_name": None, "trust_score": 61, "rationale": "r"}]))
    config.load_trust(trust, str(file))
    assert sorted((r.field_name or "", r.trust) for r in trust.read().collect()) == [("", 61), ("ltv_ratio", 70)]


def test_a_stage_that_was_killed_runs_again(spark, tmp_path, monkeypatch):
    ledger, made = Ledger(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return {"t": spark.range(3)}

    monkeypatch.setattr(ledger_module, "put_text", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        ledger.once("s", digest(1), make)
    monkeypatch.undo()
    assert ledger.latest("s") is None
    assert ledger.once("s", digest(1), make)["t"].count() == 3 and len(made) == 2
    ledger.once("s", digest(1), make)
    assert len(made) == 2
    ledger.once("s", digest(1), make, force=True)
    ledger.once("s", digest(2), make)
    assert len(made) == 4 and ledger.log == [("s", True), ("s", False), ("s", True), ("s", True)]
    assert ledger.cleared("s") == 2 and ledger.latest("s")["t"].count() == 3


def test_runs_do_only_what_is_new(spark, tmp_path, tapes_of, monkeypatch):
    folder = str(tmp_path / "state")
    first = Upload(tapes_of("a.csv", "loan_id,original_principal,property_type\nL1,5,house\nL2,-3,boat\nL3,-4,boat\n,9,x\n"), "loan_tape")
    run = lambda uploads, rules=RULES, policy=POLICY, force=False: runs.verify_folder(spark, folder, uploads, rules, policy, AT, force)
    tables, log = run([first])
    assert all(worked for _, worked in log)
    status = lambda t: sorted((r.loan_id or "", r.exception_type, r.status) for r in t["exceptions"].collect())
    assert status(tables) == [("", "import_error", "open"), ("L2", "validation_failure", "open"), ("L3", "validation_failure", "open")]
    with monkeypatch.context() as m:
        for module, name in ((landing_table, "records"), (runs.validate, "validate_records"), (runs.pipeline, "exceptions_found"), (runs.pipeline, "blended"), (runs.pipeline, "scored")):
            m.setattr(module, name, lambda *a: (_ for _ in ()).throw(AssertionError("work")))
        assert [s for s, worked in run([first])[1] if worked] == []
    by_loan = {r.loan_id: r.exception_id for r in tables["exceptions"].collect()}
    changes = [("original_principal", "30")]
    decisions = spark.createDataFrame([("d1", by_loan["L2"], "edit", 1, changes), ("d2", by_loan[None], "reject", 1, None)], "decision_id string, exception_id string, action string, decided_at long, changes array<struct<field_name:string,value:string>>")
    runs.decided(spark, folder, decisions, RULES, AT)
    tables, log = run([first])
    assert [s for s, worked in log if worked] == ["blend", "score"]
    assert {r.loan_id: r.original_principal for r in tables["canonical"].collect()} == {"L1": "5.0", "L2": "30", "L3": "-4.0"}
    assert {r.label: r.member_count for r in tables["clusters"].collect()} == {"PRINCIPAL v1": 1, "Import errors": 0}
    want = [("", "import_error", "rejected"), ("L2", "validation_failure", "resolved"), ("L3", "validation_failure", "open")]
    assert status(tables) == want
    tables, log = run([first], force=True)
    assert [s for s, worked in log if not worked] == ["land"] and status(tables) == want
    # a new file goes through all stages and gets later versions; a new trust leaves validation alone
    second = Upload(tapes_of("b.csv", "loan_id,original_principal,property_type\nL1,6,house\n"), "loan_tape")
    tables, log = run([first, second])
    assert all(worked for _, worked in log) and status(tables) == want
    assert sorted((r.loan_id, r.version, r.data.original_principal) for r in tables["records"].collect())[:2] == [("L1", 1, 5.0), ("L1", 2, 6.0)]
    _, log = run([first, second], policy=[("OriginationCore", None, 61), ("ServicerFeed", None, 80)])
    assert [s for s, worked in log if worked] == ["blend", "score"]
    _, log = run([first, second], rules=[*RULES, contracts.Rule("KIND", "LOW", "", f.property_type.given())])
    assert "validate" in {s for s, worked in log if worked} and "blend" not in {s for s, worked in log if worked and s == "records"}


def test_bad_edits_stay_open_over_runs(spark, tmp_path, tapes_of):
    folder = str(tmp_path / "state")
    upload = Upload(tapes_of("a.csv", "loan_id,original_principal\nL1,-5\nL2,3\n"), "loan_tape")
    tables, _ = runs.verify_folder(spark, folder, [upload], RULES, POLICY, AT)
    first = tables["exceptions"].first()["exception_id"]
    decisions = spark.createDataFrame([("d1", first, "edit", 1, [("original_principal", "-9")])], "decision_id string, exception_id string, action string, decided_at long, changes array<struct<field_name:string,value:string>>")
    runs.decided(spark, folder, decisions, RULES, AT)
    for force in (False, True):
        tables, _ = runs.verify_folder(spark, folder, [upload], RULES, POLICY, AT, force)
        found = {(r["raw_record_id"] is None, r["status"], r["is_blocking"]) for r in tables["exceptions"].collect()}
        assert found == {(False, "resolved", True), (True, "open", True)}
        assert {r["loan_id"] for r in tables["ready"].collect()} == {"L2"}


def test_a_stage_reads_what_it_wrote_before(spark, tmp_path):
    read = []

    def make():
        return {"a": spark.range(3).toDF("x"), "b": lambda done: (read.extend(done["a"].inputFiles()), done["a"].filter("x > 0"))[1]}

    out = Ledger(spark, str(tmp_path)).once("s", "d", make)
    assert out["b"].count() == 2 and read and all("/tables/s/a-" in p for p in read)
