"""Rules and trust policy from JSON, merged by their natural keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..contracts import DOMAINS, Rule
from ..operators.conditions import Condition
from .snapshots import Snapshots

RULES = "rule_code string, version int, scope string, severity string, message string, explanation string, condition string, source string, active boolean"
TRUST = "source_system string, field_name string, trust int, rationale string"


def rules_table(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, ["rule_code", "version"], RULES, 1)


def trust_table(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, ["source_system", "field_name"], TRUST, 1)


def _json(spark: SparkSession, path: str) -> list[dict]:
    """A configuration file, as a whole: a few rows by nature."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_rules(table: Snapshots, path: str) -> int:
    """Merge a JSON list of rules; a rule of the same code and version is replaced and made active.

    Entries hold rule_code, version (1 by default), scope, severity, message_template, condition and
    optionally explanation.  Unknown scopes and severities are refused before anything changes.
    """
    rows = []
    for r in _json(table.spark, path):
        if r["scope"] not in DOMAINS["rule_scope"] or r["severity"] not in DOMAINS["severity"]:
            raise ValueError(f"{r['rule_code']}: unknown scope or severity")
        rows.append((r["rule_code"], int(r.get("version", 1)), r["scope"], r["severity"], r["message_template"], r.get("explanation"), json.dumps(r["condition"], sort_keys=True), "seed", True))
    return table.merge(table.spark.createDataFrame(rows, RULES))


def load_trust(table: Snapshots, path: str) -> int:
    """Merge a JSON list of source_system, field_name (null for all others), trust_score and rationale."""
    rows = [(t["source_system"], t.get("field_name"), int(t["trust_score"]), t.get("rationale")) for t in _json(table.spark, path)]
    if any(not 0 <= r[2] <= 100 for r in rows):
        raise ValueError("trust is 0 to 100")
    return table.merge(table.spark.createDataFrame(rows, TRUST))


def rules_of(rows: DataFrame) -> list[Rule]:
    """Stored rules as they run: dataset rules keep their check's settings in the condition."""
    out = []
    for r in rows.orderBy("rule_code", "version").collect():
        node, row = json.loads(r["condition"]), r["scope"] == "row"
        out.append(Rule(r["rule_code"], r["severity"], r["message"], Condition(node) if row else None, None if row else node, r["version"], r["source"], r["active"]))
    return out
