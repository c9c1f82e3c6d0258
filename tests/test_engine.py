"""Ingest, rules, detectors and chains on small fixtures and against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tapewright import contracts
from tapewright.operators import chain, detect, english, validate
from tapewright.plans import pipeline
from tapewright.sources import tapes

AT = dt.datetime(2026, 8, 28, 12)
CLEAN = {
    "loan_id": "LN-000001", "borrower_id": "BR-1", "borrower_name": "Ann Lee", "original_principal": "250000.00", "current_balance": "200000.00", "interest_rate": "6.5",
    "origination_date": "2022-05-01", "maturity_date": "2052-05-01", "loan_term_months": "360", "payment_status": "Current", "days_past_due": "0", "property_state": "CA",
    "document_status": "Complete", "last_updated_at": "2026-08-20T09:00:00Z", "source_system": "OriginationCore",
}
#: The one change to a clean row, and the rules that then fail.
CASES = {
    "LN-0": ({}, set()),
    "LN-1": ({"original_principal": ""}, {"REQUIRED_CORE_FIELDS"}),
    "LN-2": ({"origination_date": "31/07/2024"}, {"INVALID_DATE_FORMAT"}),
    "LN-3": ({"original_principal": "-250000"}, {"NON_NEGATIVE_PRINCIPAL", "CURRENT_BALANCE_LE_ORIGINAL_PRINCIPAL"}),
    "LN-4": ({"maturity_date": "2020-01-01"}, {"MATURITY_AFTER_ORIGINATION"}),
    "LN-5": ({"last_updated_at": "2026-02-09T12:00:00Z"}, {"STALENESS_THRESHOLD"}),
    "LN-6": ({"last_updated_at": "2026-03-02T12:00:00Z"}, set()),
    "LN-7": ({"payment_status": "activ"}, {"VALID_PAYMENT_STATUS"}),
    "LN-8": ({"interest_rate": "41"}, {"INTEREST_RATE_IN_RANGE"}),
    "LN-9": ({"property_state": "ZZ"}, {"VALID_BORROWER_STATE"}),
    "LN-10": ({"document_status": ""}, {"REQUIRED_DOCUMENT_STATUS"}),
    "LN-11": ({"days_past_due": "45"}, {"PAYMENT_STATUS_DPD_CONSISTENT"}),
    "LN-12": ({"interest_rate": "1_0.5"}, set()),
    "LN-13": ({"current_balance": "1,25,000"}, {"INVALID_NUMERIC_FORMAT"}),
}


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tape") / "tape.csv"
    rows = [CLEAN | {"loan_id": k} | change for k, (change, _) in CASES.items()] + [CLEAN | {"loan_id": ""}]
    path.write_text("﻿" + ",".join(CLEAN) + "\n\n" + "".join(",".join(f'"{x}"' for x in r.values()) + "\n" for r in rows), encoding="utf-8")
    raw, found, errors = pipeline.ingest(spark, str(path), "loan_tape", "f1")
    assert raw.count() == len(rows) and errors.count() == 1
    return pipeline.versioned_records([found])


def test_seed_rules(records):
    rules = contracts.seed_rules()
    results = validate.validate_records(records, rules, AT).collect()
    assert len(rules) == 18 and len(results) == 15 * len(CASES)
    failed = {k: {r.rule_code for r in results if r.loan_id == k and r.result == "fail"} for k in CASES}
    assert failed == {k: want for k, (_, want) in CASES.items()}
    # a short circuit leaves one field to blame; two fields leave none
    blamed = {(r.loan_id, r.rule_code): r.field_name for r in results if r.result == "fail"}
    assert blamed["LN-2", "INVALID_DATE_FORMAT"] == "origination_date" and blamed["LN-13", "INVALID_NUMERIC_FORMAT"] is None


def test_whole_run_and_its_repetition(spark, records):
    run = pipeline.verify(records, None, contracts.trust_table(spark), AT)
    assert run.exceptions.count() == sum(len(w) for _, w in CASES.values()) + sum(r.result == "fail" for r in run.dataset_results.collect())
    assert run.canonical.count() == len(CASES) and run.scores.filter("trust_score between 0 and 100").count() == len(CASES)
    again = pipeline.verify(records, None, contracts.trust_table(spark), AT)
    assert {r.exception_id for r in run.exceptions.collect()} == {r.exception_id for r in again.exceptions.collect()}


def test_ragged_rows_are_kept_apart(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("loan_id,document_status\nA,Complete\nB\nC,Complete,extra\n")
    rows = tapes.landed(tapes.read_lines(spark, str(path), tapes.headers_of(spark, str(path))), "f", "document_manifest", ["loan_id", "document_status"])
    assert [(r.parse_error is None) for r in rows.orderBy("row_number").collect()] == [True, False, False]
    c = tapes.counters(rows).first()
    assert (c.row_count, c.parsed_count, c.failed_count) == (3, 1, 2)


def test_rows_are_numbered_by_file(spark, tmp_path):
    for name, loans in (("a.csv", "AB"), ("b.csv", "CDE")):
        (tmp_path / name).write_text("\n".join(["loan_id", *loans]) + "\n")
    rows = tapes.landed(tapes.read_lines(spark, str(tmp_path), ["loan_id"]), "f", "document_manifest", ["loan_id"], by_file=True).collect()
    assert sorted((r.raw_file_id, r.row_number, r.payload["loan_id"]) for r in rows) == [("f#a.csv", 1, "A"), ("f#a.csv", 2, "B"), ("f#b.csv", 1, "C"), ("f#b.csv", 2, "D"), ("f#b.csv", 3, "E")]
    assert len({r.raw_record_id for r in rows}) == 5


def test_bursts_equal_brute_force(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(i, rng.choice("abcdefgh") if rng.random() > 0.05 else None, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(900)) if rng.random() > 0.05 else None) for i in range(300)]
        got = {r.id: r.result for r in detect.repeat_pattern(spark.createDataFrame(rows, "id long, who string, at timestamp"), "who", "at", 3, 30).collect()}
        want = {i: "pass" if k and t else "not_applicable" for i, k, t in rows}
        for _, k, start in rows:
            if k and start:
                inside = [i for i, k2, t in rows if k2 == k and t and 0 <= (t - start).days <= 30]
                if len(inside) > 3:
                    want.update(dict.fromkeys(inside, "fail"))
        assert got == want


def test_duplicates_and_clones(spark):
    rows = spark.createDataFrame([(1, "f", "x", "n"), (2, "f", "x", "n"), (3, "g", "x", None), (4, "g", None, "n"), (5, "g", "y", "n")], "id long, file string, loan string, name string")
    assert {r.id: r.result for r in detect.duplicate_key(rows, ["loan"], ["file"]).collect()} == {1: "fail", 2: "fail", 3: "pass", 4: "not_applicable", 5: "pass"}
    assert {r.id: r.result for r in detect.fingerprint_duplicate(rows, ["name"], "loan").collect()} == {1: "fail", 2: "fail", 3: "not_applicable", 4: "fail", 5: "fail"}


def test_material_differences(spark):
    rows = spark.createDataFrame([(0.0, 500.0), (0.0, 500.01), (100_000.0, 100_600.0), (100_000.0, 98_000.0)], "a double, b double")
    assert [r[0] for r in rows.select(detect.material(F.col("a"), F.col("b"), 500.0, 0.01)).collect()] == [False, True, False, True]


def test_chains_find_forged_rows(spark):
    events = spark.createDataFrame([(c, i, f"e{i}é\"", None if i % 3 else "r") for c in "ab" for i in range(6)], "chain string, seq long, what string, reason string")
    linked = chain.appended(events, ["chain"], ["seq"], ["what", "reason"])
    assert chain.intact(linked, ["chain"], ["seq"], ["what", "reason"])
    forged = linked.withColumn("what", F.when((F.col("chain") == "a") & (F.col("seq") >= 3), "forged").otherwise(F.col("what")))
    assert [(r.chain, r.seq, r.problem) for r in chain.first_break(forged, ["chain"], ["seq"], ["what", "reason"]).collect()] == [("a", 3, "hash mismatch")]
    cut = linked.filter("not (chain = 'b' and seq = 2)")
    assert [(r.chain, r.seq, r.problem) for r in chain.first_break(cut, ["chain"], ["seq"], ["what", "reason"]).collect()] == [("b", 3, "broken link")]
    assert chain.canonical_json({"b": 1, "a": {"d": None, "c": 2.5}}) == chain.canonical_json({"a": {"c": 2.5, "d": None}, "b": 1}) == '{"a":{"c":2.5,"d":null},"b":1}'


def test_chains_over_many_ranges(spark):
    """Gaps of ranges, chains without a key, and marks; whole rows are moved once and joined with nothing."""
    events = spark.createDataFrame([(c, i * chain.RANGE // 3, f"e{i}\t\"") for c in ("a", "b", None) for i in (*range(7), 30, 31)], "chain string, seq long, what string")
    linked = chain.appended(events, ["chain"], ["seq"], ["seq", "what"])
    own = lambda r: chain.hashlib.sha256(chain.canonical_json({"seq": str(r.seq), "what": r.what, chain.PREV: r.prev_hash}).encode()).hexdigest()
    held = linked.collect()
    assert all(r.hash == own(r) for r in held) and {r.prev_hash for r in held if r.seq} <= {r.hash for r in held}
    assert chain.intact(linked, ["chain"], ["seq"], ["seq", "what"])
    late = 30 * chain.RANGE // 3
    cut = linked.filter(f"not (seq = {6 * chain.RANGE // 3} and chain is null)")
    assert [tuple(r) for r in chain.first_break(cut, ["chain"], ["seq"], ["seq", "what"]).collect()] == [(None, late, "broken link")]
    checked = chain.checked(linked, ["chain"], ["seq"], ["seq", "what"])
    assert "Join" not in checked._jdf.queryExecution().optimizedPlan().toString()
    marks = chain.marked(linked.filter(f"seq < {late} and chain is not null"), ["chain"], "seq")
    since = chain.checked(linked, ["chain"], ["seq"], ["seq", "what"], marks=marks)
    assert sorted(r.chain or "" for r in since.collect()) == [""] * 9 + ["a"] * 2 + ["b"] * 2 and since.filter("problem is not null").isEmpty()


@pytest.mark.parametrize("query", ["chains_since_marks", "chains_reported"])
def test_chains_are_linked_once(spark, small, query):
    """Linking is one pass over a log however often it is checked: no plan of a check holds it again."""
    from tapewright.plans import state_queries

    assert "MapInPandas" not in getattr(state_queries, query)(spark, small)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text, operator, value", [("interest rate is above 36", "<=", 36), ("interest rate is no more than 3", ">", 3), ("interest rate not above 36", ">", 36)])
def test_english_rules(text, operator, value):
    node = english.draft(text).condition.node
    assert (node["operator"], node["right"]["value"]) == (operator, value)


def test_english_that_says_nothing():
    for text in ("", "the weather is bad", "interest rate is 36"):
        with pytest.raises(ValueError):
            english.draft(text)


def test_digests_move_as_bytes(spark):
    """No shuffle of a check holds a digest as text."""
    rows = spark.createDataFrame([("a", i, "x" * 64, "x" * 64) for i in range(4)], "chain string, seq long, prev_hash string, hash string")
    checked = chain.checked(rows, ["chain"], ["seq"], ["seq"]).select("chain", "seq", "problem")
    windows, todo = [], [checked._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("Window", "Aggregate"):
            windows.append(node.children().apply(0).schema().catalogString())
    assert windows and not any("hash" in w for w in windows)


def test_packed_digests_are_equal_for_equal_text_only(spark):
    texts = ["", "ab", "AB", "aB", "abc", "0ab", "00ab", "\x00", "\x01", "é", "zz", "ab" * 32, "AB" * 32, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chain._packed(F.col("t")).alias("p")).collect()
    assert len({bytes(r.p) for r in rows if r.p is not None}) == len(texts) - 1 and [r.t for r in rows if r.p is None] == [None]
    assert max(len(r.p) for r in rows if r.t == "ab" * 32) == 33
