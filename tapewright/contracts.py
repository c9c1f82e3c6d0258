"""The record contract: fields and their types, vocabularies, seed rules and source trust."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.conditions import Condition, all_of, any_of, days_between, fields, now, source_system

# --- fixed values ---------------------------------------------------------------
#: Canonical fields in order, with their types.
FIELD_TYPES: dict[str, str] = {
    "loan_id": "str",
    "borrower_id": "str",
    "borrower_name": "str",
    "original_principal": "float",
    "current_balance": "float",
    "interest_rate": "float",
    "origination_date": "date",
    "maturity_date": "date",
    "loan_term_months": "int",
    "payment_status": "status",
    "days_past_due": "int",
    "property_state": "str",
    "loan_purpose": "str",
    "property_type": "str",
    "credit_score": "int",
    "ltv_ratio": "float",
    "dti_ratio": "float",
    "document_status": "str",
    "last_updated_at": "ts",
    "source_system": "str",
    "servicer_name": "str",
}
#: Headers that name a canonical field otherwise.
HEADER_ALIASES = {"received_date": "last_updated_at"}
#: Payment statuses as sources write them, in lower case.
PAYMENT_STATUS = {
    "current": "current",
    "30-59 days": "dpd_30_59",
    "60-89 days": "dpd_60_89",
    "90+ days": "dpd_90_plus",
    "default": "default",
    "paid off": "paid_off",
    "closed": "closed",
}
DELINQUENT = ["dpd_30_59", "dpd_60_89", "dpd_90_plus", "default"]
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
#: Which source a kind of file comes from.
FILE_SOURCES = {"loan_tape": "OriginationCore", "servicer_update": "ServicerFeed", "document_manifest": "DocumentManifest"}
DOMAINS: dict[str, tuple[str, ...]] = {
    "role": ("operator", "reviewer", "consumer"),
    "file_kind": ("loan_tape", "servicer_update", "document_manifest"),
    "file_status": ("processing", "completed", "failed"),
    "loan_status": ("ingested", "in_review", "verified", "rejected"),
    "record_origin": ("import", "human_edit"),
    "rule_scope": ("row", "dataset", "cross_source"),
    "rule_source": ("seed", "ai_generated", "manual"),
    "severity": ("LOW", "MEDIUM", "HIGH", "CRITICAL"),
    "result": ("pass", "fail", "not_applicable"),
    "exception_type": ("validation_failure", "source_conflict", "staleness", "duplicate", "import_error"),
    "exception_status": ("open", "in_review", "resolved", "rejected"),
    "recommendation": ("explain_failure", "suggest_correction", "reviewer_note", "classify_severity", "batch_summary"),
    "decision_scope": ("exception", "loan"),
    "decision_action": ("accept", "edit", "reject", "manual_resolution", "approve_loan", "reject_loan"),
    "actor_type": ("human", "ai", "system"),
    "event_type": (
        "file_uploaded",
        "record_imported",
        "validation_executed",
        "exception_created",
        "ai_recommendation_generated",
        "reviewer_comment_added",
        "field_edited",
        "loan_approved",
        "loan_rejected",
        "verified_record_created",
        "verified_record_exported",
        "rule_created",
        "rule_deactivated",
        "correction_requested",
        "trust_config_updated",
    ),
}
#: (source, field or None for all others, trust).
SOURCE_TRUST = [
    ("OriginationCore", None, 62),
    ("OriginationCore", "original_principal", 90),
    ("OriginationCore", "current_balance", 55),
    ("OriginationCore", "payment_status", 55),
    ("OriginationCore", "days_past_due", 55),
    ("OriginationCore", "document_status", 40),
    ("ServicerFeed", None, 88),
    ("ServicerFeed", "original_principal", 60),
    ("ServicerFeed", "current_balance", 92),
    ("ServicerFeed", "payment_status", 92),
    ("ServicerFeed", "days_past_due", 92),
    ("ServicerFeed", "document_status", 50),
    ("DocumentManifest", None, 70),
    ("DocumentManifest", "document_status", 95),
    ("human_override", None, 100),
]
HUMAN = "human_override"
STALE_DAYS, HIGHEST_RATE = 180, 36
BURST = (3, 90)  # more than so many loans within so many days
# ----------------------------------------------------------------------------------

SEVERITY_RANK = {s: i for i, s in enumerate(DOMAINS["severity"], 1)}
BLOCKING = ("HIGH", "CRITICAL")


@dataclass(frozen=True)
class Rule:
    """One published rule.  A row rule has a condition; a dataset rule has a check with its settings."""

    code: str
    severity: str
    message: str
    condition: Condition | None = None
    check: dict | None = None
    version: int = 1
    source: str = "seed"
    active: bool = True
    order: int = field(default=0, compare=False)

    @property
    def scope(self) -> str:
        return "row" if self.check is None else "dataset"


# --- fixed values: codes, severities, messages and settings of the seed rules -----
def seed_rules() -> list[Rule]:
    """The eighteen seed rules; a condition holds for a record that is fine."""
    f = fields()
    closed = f.payment_status.in_set(["closed", "paid_off"])
    row = [
        Rule("REQUIRED_CORE_FIELDS", "CRITICAL", "Missing a core field (loan_id / original_principal / origination_date).", all_of(f.loan_id.given(), f.original_principal.given(), f.origination_date.given())),
        Rule("INVALID_DATE_FORMAT", "MEDIUM", "A date field could not be parsed.", all_of(~f.origination_date.malformed(), ~f.maturity_date.malformed(), ~f.last_updated_at.malformed())),
        Rule("INVALID_NUMERIC_FORMAT", "MEDIUM", "A numeric field could not be parsed.", all_of(~f.original_principal.malformed(), ~f.current_balance.malformed(), ~f.interest_rate.malformed())),
        Rule("MATURITY_AFTER_ORIGINATION", "HIGH", "maturity_date {maturity_date} is not after origination_date {origination_date}.", f.maturity_date > f.origination_date),
        Rule("NON_NEGATIVE_PRINCIPAL", "CRITICAL", "original_principal {original_principal} is negative.", f.original_principal >= 0),
        Rule("NON_NEGATIVE_BALANCE", "CRITICAL", "current_balance {current_balance} is negative.", f.current_balance >= 0),
        Rule("CURRENT_BALANCE_LE_ORIGINAL_PRINCIPAL", "HIGH", "current_balance {current_balance} exceeds original_principal {original_principal}.", f.current_balance <= f.original_principal),
        Rule("INTEREST_RATE_IN_RANGE", "MEDIUM", "interest_rate {interest_rate} is outside the plausible 0–36% range.", all_of(f.interest_rate > 0, f.interest_rate <= HIGHEST_RATE)),
        Rule("PAYMENT_STATUS_DPD_CONSISTENT", "HIGH", "payment_status is current but days_past_due is {days_past_due}.", any_of(~f.payment_status.equals("current"), f.days_past_due.equals(0))),
        Rule("DELINQUENT_STATUS_DPD_CONSISTENT", "HIGH", "payment_status is delinquent/default but days_past_due is {days_past_due}.", any_of(~f.payment_status.in_set(DELINQUENT), f.days_past_due > 0)),
        Rule("REQUIRED_DOCUMENT_STATUS", "MEDIUM", "document_status is missing on the reconciled record.", f.document_status.given()),
        Rule("VALID_PAYMENT_STATUS", "LOW", "payment_status {payment_status} is not a recognized value.", f.payment_status.in_set(list(PAYMENT_STATUS.values()))),
        Rule("STALENESS_THRESHOLD", "MEDIUM", "last_updated_at {last_updated_at} is more than 180 days old.", any_of(~source_system().equals("OriginationCore"), days_between(now(), f.last_updated_at) <= STALE_DAYS)),
        Rule("VALID_BORROWER_STATE", "LOW", "property_state {property_state} is not a valid US state code.", f.property_state.upper().in_set(STATES)),
        Rule("CLOSED_LOAN_ZERO_BALANCE", "HIGH", "payment_status is closed/paid_off but current_balance is {current_balance}.", any_of(~closed, f.current_balance.equals(0))),
    ]
    dataset = [
        Rule("DUPLICATE_LOAN_ID", "HIGH", "loan_id {loan_id} appears more than once in the same file.", check={"check": "duplicate_key", "keys": ["loan_id"], "partition_by": "raw_file_id"}),
        Rule("DUPLICATE_BORROWER_FINGERPRINT", "HIGH", "Same borrower + principal + origination date under a different loan_id — likely a duplicate.", check={"check": "fingerprint_duplicate", "keys": ["borrower_name", "original_principal", "origination_date"], "partition_by": "global"}),
        Rule("REPEATED_BORROWER_PATTERN", "MEDIUM", "borrower_id {borrower_id} originated more than 3 loans within 90 days.", check={"check": "repeat_pattern", "key": "borrower_id", "count_gt": BURST[0], "window_days": BURST[1], "partition_by": "global"}),
    ]
    return row + dataset


# -----------------------------------------------------------------------------------


def trust_table(spark: SparkSession, rows: list[tuple[str, str | None, int]] | None = None) -> DataFrame:
    """(source_system, field_name, trust): a few rows of policy, as data."""
    return spark.createDataFrame(rows or SOURCE_TRUST, "source_system string, field_name string, trust int")


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """Rules as data, newest first, then by code."""
    rows = [(r.code, r.version, r.scope, r.severity, r.message, r.condition.to_json() if r.condition else None, str(r.check) if r.check else None, r.source, r.active) for r in rules or seed_rules()]
    schema = "rule_code string, version int, scope string, severity string, message string, condition string, check string, source string, active boolean"
    return spark.createDataFrame(rows, schema).orderBy(F.desc("version"), "rule_code")


def publish(rules: list[Rule], new: Rule) -> list[Rule]:
    """Add a rule as the next version of its code; earlier versions stay active."""
    if new.severity not in DOMAINS["severity"] or new.source not in DOMAINS["rule_source"]:
        raise ValueError("unknown severity or source")
    version = 1 + max((r.version for r in rules if r.code == new.code), default=0)
    return [*rules, Rule(new.code, new.severity, new.message, new.condition, new.check, version, new.source)]


def set_active(rules: list[Rule], code: str, version: int, active: bool) -> list[Rule]:
    """Switch one version on or off; it is an error if nothing changes."""
    hit = [r for r in rules if (r.code, r.version) == (code, version)]
    if not hit or hit[0].active == active:
        raise ValueError(f"{code} v{version}: nothing to change")
    return [Rule(r.code, r.severity, r.message, r.condition, r.check, r.version, r.source, active) if r is hit[0] else r for r in rules]


def outside_domain(df: DataFrame, column: str, domain: str) -> DataFrame:
    """Rows whose value is not in a vocabulary (nulls pass, as in a check constraint)."""
    return df.filter(~F.col(column).isin(*DOMAINS[domain]))


def assert_domain(df: DataFrame, column: str, domain: str) -> DataFrame:
    if not outside_domain(df, column, domain).isEmpty():
        raise ValueError(f"{column} holds values outside {domain}")
    return df
