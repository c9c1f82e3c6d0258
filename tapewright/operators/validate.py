"""Running rules over records: results, exceptions, previews and re-runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import BLOCKING, FIELD_TYPES, Rule
from . import detect
from .conditions import Binding, Compiler, Condition, clock, kind_of, rendered, text_of, verdict


def record_binding(records: DataFrame, at: dt.datetime | str) -> Binding:
    """Bind canonical records: data, in_scope and field_errors, and the record's source."""
    kinds = {f.name: kind_of(f.dataType) for f in records.schema["data"].dataType}
    return Binding(
        kinds,
        lambda f: F.col(f"data.{f}"),
        lambda f: F.array_contains("in_scope", f),
        lambda f: F.map_contains_key("field_errors", F.lit(f)),
        F.col("source_system"),
        clock(at),
        lambda f: F.try_element_at("field_errors", F.lit(f)),
    )


def _kind(binding: Binding, types: dict[str, str], f: str) -> str:
    return "double" if types.get(f) == "double" else binding.kinds.get(f, "str")


#: How much a result tells: the verdict alone; fields, values and message; these with errors and what is out of scope.
VERDICT, MESSAGE, DETAILS = range(3)
ERROR = "struct<raw:string,expected:string>"


def outcome(rule: Rule, binding: Binding, types: dict[str, str], tells: int = MESSAGE) -> Column:
    """One rule's result on a row: the verdict and, as far as ``tells`` asks for it, what led to it.

    ``MESSAGE`` adds the fields touched, their values, the blamed field and the message; ``DETAILS``
    the errors of touched fields and those of them that the record's source doesn't supply.
    """
    c = Compiler(binding).compile(rule.condition.node)
    named = (F.lit(rule.code).alias("rule_code"), F.lit(rule.version).alias("rule_version"), F.lit(rule.severity).alias("severity"))
    if tells == VERDICT:
        return F.struct(*named, verdict(c).alias("result"))
    value = {f: F.when(binding.in_scope(f) & ~binding.malformed(f), text_of(binding.value(f), _kind(binding, types, f))) for f in _fields(rule.condition.node) if f in binding.kinds}
    touched = F.array_sort(c.touched)
    shown = lambda f: F.when(F.array_contains(touched, f), value[f]) if f in value else F.lit(None).cast("string")
    pairs = [F.struct(F.lit(f).alias("key"), shown(f).alias("value")) for f in sorted(value)]
    values = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    result = verdict(c)
    more = ()
    if tells == DETAILS:
        asked = _fields(rule.condition.node)
        no_error = F.lit(None).cast(ERROR)
        bad = [F.struct(F.lit(f).alias("key"), F.when(F.array_contains(touched, f) & binding.malformed(f), binding.error(f) if binding.error else no_error).cast(ERROR).alias("value")) for f in sorted(asked) if f in binding.kinds]
        errors = F.map_from_entries(F.filter(F.array(*bad), lambda e: e["value"].isNotNull())) if bad else F.create_map()
        scope = F.filter(F.array(*(F.when(binding.in_scope(f), F.lit(f)) for f in asked if f in binding.kinds)), lambda f: f.isNotNull()) if asked else F.array()
        more = (errors.cast(f"map<string,{ERROR}>").alias("field_errors"), out_of_scope(touched, scope.cast("array<string>")).alias("out_of_scope"))
    return F.struct(
        *named,
        result.alias("result"),
        touched.alias("touched"),
        values.cast("map<string,string>").alias("values"),
        F.when(F.size(touched) == 1, touched[0]).alias("field_name"),
        F.when(result == "fail", rendered(rule.message, shown)).alias("message"),
        *more,
    )


def _fields(node: dict) -> list[str]:
    """Field names in a tree, in the order of first sight."""
    if not isinstance(node, dict):
        return []
    own = [node["name"]] if node.get("type") == "field" else []
    parts = [*node.get("operands", []), *node.get("args", []), *(node[k] for k in ("operand", "left", "right") if k in node)]
    return list(dict.fromkeys(own + [f for p in parts for f in _fields(p)]))


def run_rules(rows: DataFrame, rules: list[Rule], binding: Binding, keep: list[str], types: dict[str, str] | None = None, tells: int = MESSAGE) -> DataFrame:
    """A row for each (row, active row rule): ``keep`` and the outcome's columns.

    All rules are one projection over one scan; no join with the rules is needed.
    """
    types = types or dict(rows.dtypes)
    outcomes = [outcome(r, binding, types, tells) for r in sorted(rules, key=lambda r: (r.code, r.version)) if r.active and r.scope == "row"]
    return rows.select(*keep, F.inline(F.array(*outcomes)))


def tallied(rows: DataFrame, rules: list[Rule], binding: Binding) -> DataFrame:
    """Counts of verdicts by active row rule, as ``tally`` gives them, in one aggregate over the rows: no row is repeated for its rules."""
    active = [r for r in sorted(rules, key=lambda r: (r.code, r.version)) if r.active and r.scope == "row"]
    verdicts = [verdict(Compiler(binding).compile(r.condition.node)) for r in active]
    judged = rows.select(*(v.alias(f"v{i}") for i, v in enumerate(verdicts)))
    counts = judged.agg(*(F.count_if(F.col(f"v{i}") == s).alias(f"v{i}_{s}") for i in range(len(active)) for s in VERDICTS))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(r.code).alias("rule_code"), F.lit(r.version).alias("rule_version"), *(F.col(f"v{i}_{s}").alias(s) for s in VERDICTS)) for i, r in enumerate(active)))))


VERDICTS = ("pass", "fail", "not_applicable")


def validate_records(records: DataFrame, rules: list[Rule], at: dt.datetime | str, origins: tuple[str, ...] = ("import",), tells: int = MESSAGE) -> DataFrame:
    """Row-rule results of canonical records; human edits take part only if asked."""
    mine = records.filter(F.col("origin").isin(*origins)) if "origin" in records.columns else records
    types = {f.name: f.dataType.simpleString() for f in records.schema["data"].dataType}
    keep = [c for c in ("raw_record_id", "raw_file_id", "source_system", "version") if c in records.columns]
    return run_rules(mine, rules, record_binding(records, at), [F.col("data.loan_id").alias("loan_id"), *keep], types, tells)


def validate_dataset(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """Dataset-rule results of records of all origins; messages draw on the whole record."""
    flat = records.select("raw_record_id", "raw_file_id", "data", *(F.col(f"data.{f}").alias(f) for f in FIELD_TYPES))
    out = None
    for rule in (r for r in rules if r.active and r.scope == "dataset"):
        done = apply_check(flat, rule.check)
        shown = lambda f: text_of(F.col(f), "double" if FIELD_TYPES.get(f) == "float" else "str") if f in FIELD_TYPES else F.lit(None).cast("string")
        one = done.select(
            "loan_id",
            "raw_record_id",
            "raw_file_id",
            F.lit(rule.code).alias("rule_code"),
            F.lit(rule.version).alias("rule_version"),
            F.lit(rule.severity).alias("severity"),
            "result",
            F.lit(None).cast("string").alias("field_name"),
            F.when(F.col("result") == "fail", rendered(rule.message, shown)).alias("message"),
            F.lit(rule.check.get("partition_by", "global")).alias("partition_by"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def apply_check(rows: DataFrame, check: dict) -> DataFrame:
    """``rows`` with the ``result`` of a named dataset check."""
    name = check["check"]
    if name == "duplicate_key":
        part = check.get("partition_by", "global")
        return detect.duplicate_key(rows, check["keys"], None if part == "global" else [part])
    if name == "fingerprint_duplicate":
        return detect.fingerprint_duplicate(rows, check["keys"], check.get("identity", "loan_id"))
    if name == "repeat_pattern":
        return detect.repeat_pattern(rows, check["key"], check.get("when", "origination_date"), check["count_gt"], check["window_days"])
    raise ValueError(f"unknown dataset check: {name!r}")


def exceptions_of(results: DataFrame, per: str) -> DataFrame:
    """validation_failure exceptions of failed results, one for each rule and ``per`` (raw_record_id, or loan_id for dataset rules)."""
    bad = results.filter("result = 'fail'")
    if per == "loan_id":
        first = F.min(F.struct("raw_record_id", "rule_version", "field_name", "severity", "message")).alias("x")
        alone = F.when(F.col("loan_id").isNull(), F.col("raw_record_id"))
        bad = bad.groupBy("rule_code", "loan_id", alone.alias("_alone")).agg(first).select("rule_code", "loan_id", "x.*")
    other = "loan_id" if per == "raw_record_id" else "raw_record_id"
    return bad.select(
        F.sha2(F.concat_ws("|", F.lit("validation_failure"), "rule_code", F.col("rule_version").cast("string"), F.coalesce(F.col(per).cast("string"), F.col(other).cast("string"))), 256).alias("exception_id"),
        "loan_id",
        "raw_record_id",
        F.lit("validation_failure").alias("exception_type"),
        "rule_code",
        "rule_version",
        "field_name",
        "severity",
        F.col("severity").isin(*BLOCKING).alias("is_blocking"),
        F.lit("open").alias("status"),
        "message",
        F.lit(per).alias("decided_per"),
    )


def out_of_scope(touched: Column, scope: Column) -> Column:
    """Fields that a rule touched although the record's source doesn't supply them."""
    return F.array_sort(F.array_except(touched, scope))


def tally(results: DataFrame) -> DataFrame:
    """Counts of verdicts by rule."""
    n = lambda s: F.count_if(F.col("result") == s).alias(s)
    return results.groupBy("rule_code", "rule_version").agg(n("pass"), n("fail"), n("not_applicable"))


def rerun(existing: DataFrame | None, fresh: DataFrame, keys: list[str], rule_codes: list[str] | None = None) -> DataFrame:
    """Exceptions after a forced run: decided ones stay, open ones are made anew.

    A fresh exception is left out if a decision for its keys exists.  Exceptions of rules
    that didn't run stay as they are.
    """
    if existing is None:
        return fresh
    ran = F.col("rule_code").isin(*rule_codes) if rule_codes is not None else F.lit(True)
    kept = existing.filter(~F.coalesce(ran, F.lit(True)) | (F.col("status") != "open"))
    decided = kept.filter(F.col("status") != "open").select(*keys).distinct()
    return kept.unionByName(fresh.join(decided, keys, "left_anti"), allowMissingColumns=True)


def already_run(results: DataFrame | None, rules: list[Rule]) -> bool:
    """Whether any active rule has results; a run without force then does nothing."""
    codes = [r.code for r in rules if r.active]
    return results is not None and not results.filter(F.col("rule_code").isin(*codes)).isEmpty()


def preview(rows: DataFrame, condition: Condition, binding: Binding, sample_order: list[str], samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """A dry run of one condition: its tally, and the first failing rows in ``sample_order``."""
    judged = rows.withColumn("result", verdict(Compiler(binding).compile(condition.node)))
    return judged.groupBy("result").agg(F.count(F.lit(1)).alias("n")), judged.filter("result = 'fail'").orderBy(*sample_order).limit(samples)
