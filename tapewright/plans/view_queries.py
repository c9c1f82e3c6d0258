"""More of the engine's own functions as queries: gates, chains, read views, English rules, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Rule
from ..operators import assist, chain, english, reconcile, resolve, trust, validate
from ..operators.conditions import Condition
from ..sources.shared import written
from ..sources.tables import table
from . import views
from .queries import _EXCEPTIONS_SQL, _exceptions, _tally, _verdict_sql, register


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions over orders as the views take them; a third of the open ones are in review."""
    e = _exceptions(spark, d).withColumn("exception_id", F.col("id")).withColumn("loan_id", F.col("k"))
    return e.withColumn("status", F.when((F.col("status") == "open") & (F.col("id") % 3 == 0), "in_review").otherwise(F.col("status"))).withColumn("is_blocking", F.col("severity").isin("HIGH", "CRITICAL"))


_QUEUE_SQL = f"{_EXCEPTIONS_SQL}, q AS (SELECT * REPLACE (CASE WHEN status = 'open' AND id % 3 = 0 THEN 'in_review' ELSE status END AS status), severity IN ('HIGH', 'CRITICAL') AS is_blocking FROM exc)"
_VERIFIED_SQL = "v AS (SELECT o_custkey AS loan_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_totalprice / 5000 AS trust_score FROM orders)"


def _verified(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.row_number().over(order).alias("version"), (F.col("o_totalprice") / 5000).alias("trust_score"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("loan_id"), F.col("c_name").alias("borrower_id"), F.col("c_mktsegment").alias("status"))


@register(f"WITH {_QUEUE_SQL} SELECT c_custkey AS loan_id FROM customer WHERE c_custkey NOT IN (SELECT k FROM q WHERE status = 'open' AND is_blocking)")
def eligibility_open_only(spark: SparkSession, d: str) -> DataFrame:
    """Exceptions in review don't block."""
    return trust.eligible(_customers(spark, d).select("loan_id"), _queue(spark, d), "loan_id")


@register(
    f"""WITH {_QUEUE_SQL} SELECT CASE WHEN c_custkey % 3 = 0 THEN 'verified' WHEN c_custkey IN (SELECT k FROM q WHERE status = 'open' AND is_blocking) THEN 'blocked' ELSE 'eligible' END AS state, count(*) AS n FROM customer GROUP BY 1"""
)
def verification_states(spark: SparkSession, d: str) -> DataFrame:
    loans = _customers(spark, d).select("loan_id")
    return trust.verification_summary(loans, _queue(spark, d), loans.filter("loan_id % 3 = 0"), "loan_id")


@register(f"WITH {_QUEUE_SQL} SELECT c_custkey AS loan_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT k FROM q WHERE status = 'open' AND is_blocking) ORDER BY 1 LIMIT 25")
def verify_next(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 loans of a batch verification: the limit is the feature."""
    loans = _customers(spark, d).select("loan_id")
    return trust.to_verify(loans, _queue(spark, d), loans.filter("loan_id % 3 = 0"), "loan_id", 25)


_CHAIN_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, '{"a":{"v":' || event_id || '},"z":1}' AS canon, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  c AS (SELECT user_id, event_id, rn, CAST(NULL AS VARCHAR) AS prev_hash, sha256('{"after_value":' || canon || ',"event_id":"' || event_id || '","event_type":"' || event_type || '","prev_event_hash":null}') AS hash FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, c.hash, sha256('{"after_value":' || canon || ',"event_id":"' || e.event_id || '","event_type":"' || event_type || '","prev_event_hash":"' || c.hash || '"}') FROM c JOIN e ON e.user_id = c.user_id AND e.rn = c.rn + 1)"""
_CHAIN = (["user_id"], ["event_id"], ["event_id", "event_type", "after_value"])


def _chained(spark: SparkSession, d: str) -> DataFrame:
    nested = F.concat(F.lit('{ "z": 1, "a": {"v": '), F.col("event_id").cast("string"), F.lit("} }"))
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", nested.alias("after_value"))
    return chain.appended(rows, *_CHAIN, nested=("after_value",))


@register(f"{_CHAIN_SQL} SELECT event_id, prev_hash, hash FROM c")
def audit_chain_appended(spark: SparkSession, d: str) -> DataFrame:
    """Digests over nested JSON and the digest before."""
    return _chained(spark, d).select("event_id", "prev_hash", "hash")


@register(
    f"""{_CHAIN_SQL} SELECT user_id, min(event_id) AS event_id, min_by(CASE WHEN event_id % 97 = 0 AND rn > 1 THEN 'broken link' ELSE 'hash mismatch' END, event_id) AS problem
      FROM c WHERE event_id % 97 = 0 AND rn > 1 OR event_id % 89 = 0 GROUP BY user_id"""
)
def audit_chain_first_break(spark: SparkSession, d: str) -> DataFrame:
    """Forged contents and cut links, the first of each chain."""
    k = F.col("event_id")
    forged = written(_chained(spark, d), "chain", "zstd").withColumn("event_type", F.when(k % 89 == 0, "forged").otherwise(F.col("event_type"))).withColumn("prev_hash", F.when(k % 97 != 0, F.col("prev_hash")))
    return chain.first_break(forged, *_CHAIN, nested=("after_value",))


@register(
    f"""WITH {_QUEUE_SQL} SELECT 'status' AS part, status AS value, count(*) AS n FROM q GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'exception_type', exception_type, count(*) FROM q GROUP BY 2
      UNION ALL SELECT 'total', NULL, count(*) FROM q UNION ALL SELECT 'loans_with_open', NULL, count(DISTINCT k) FROM q WHERE status = 'open' UNION ALL SELECT 'loans_by_status', c_mktsegment, count(*) FROM customer GROUP BY 2
      UNION ALL SELECT 'trust_histogram', CASE WHEN s >= 90 THEN 'high' WHEN s >= 75 THEN 'good' WHEN s >= 50 THEN 'fair' ELSE 'low' END, count(*) FROM (SELECT o_totalprice / 5000 AS s FROM orders) GROUP BY 2
      UNION ALL SELECT 'source_coverage', o_orderpriority, count(DISTINCT o_custkey) FROM orders GROUP BY 2 UNION ALL SELECT 'results', CASE WHEN o_totalprice <= 120000 THEN 'pass' ELSE 'fail' END, count(*) FROM orders GROUP BY 2"""
)
def dashboard_parts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("loan_id", F.col("o_custkey")).withColumn("source_system", F.col("o_orderpriority"))
    results = orders.select(F.when(F.col("o_totalprice") <= 120000, "pass").otherwise("fail").alias("result"))
    parts = views.dashboard(_customers(spark, d), _queue(spark, d), _verified(spark, d), orders, results)
    out = parts["exceptions"].select(F.col("dimension").alias("part"), "value", "n")
    for name, value, n in (("loans_with_open", None, "n"), ("loans_by_status", "status", "n"), ("trust_histogram", "bucket", "n"), ("source_coverage", "source_system", "loans"), ("results", "result", "n")):
        out = out.unionByName(parts[name].select(F.lit(name).alias("part"), (F.col(value) if value else F.lit(None).cast("string")).alias("value"), F.col(n).alias("n")))
    return out


@register(
    f"""WITH {_QUEUE_SQL} SELECT id AS exception_id, c_name AS borrower_id, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, id) AS place
      FROM q JOIN customer ON c_custkey = k WHERE status = 'open' AND is_blocking AND (c_name ILIKE '%00%1%' OR CAST(k AS VARCHAR) ILIKE '%00%1%')"""
)
def exception_queue(spark: SparkSession, d: str) -> DataFrame:
    """The review queue with filters and a search, most severe first."""
    from pyspark.sql import Window

    loans = _customers(spark, d)
    found = views.exceptions_list(_queue(spark, d).withColumn("loan_id", F.col("loan_id").cast("string")), loans.withColumn("loan_id", F.col("loan_id").cast("string")), status="open", blocking_only=True, search="00%1")
    place = F.row_number().over(Window.orderBy(resolve.severity_rank(F.col("severity")).desc(), "exception_id"))
    return found.select("exception_id", "borrower_id", place.alias("place"))


@register(f"WITH {_VERIFIED_SQL} SELECT loan_id, max(version) AS version FROM v WHERE trust_score >= 40 GROUP BY 1")
def verified_latest(spark: SparkSession, d: str) -> DataFrame:
    return views.verified_list(_verified(spark, d), min_trust=40, latest_only=True).select("loan_id", "version")


@register("SELECT event_id AS seq FROM events WHERE event_type = 'click' AND event_id BETWEEN 100 AND 5000")
def audit_event_range(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("seq", F.col("event_id"))
    return views.audit_events(events, event_type="click", from_seq="100", to_seq=5000).select("seq")


@register(f"WITH {_QUEUE_SQL} SELECT k AS loan_id, count(*) AS n_exceptions FROM q WHERE status = 'open' AND rule_code = 'RULE_1' AND severity = 'HIGH' GROUP BY 1")
def batch_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.batch_counts(resolve.batch(_queue(spark, d), rule_code="RULE_1", severity="HIGH"), "b1").select("loan_id", "n_exceptions")


@register(
    """SELECT 'DUPLICATE' AS rule_code, o_custkey AS loan_id, min(o_orderkey) AS raw_record_id FROM orders WHERE o_totalprice > 200000 GROUP BY 2"""
)
def dataset_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """A dataset rule's failures: one exception for each loan, however many of its records fail."""
    rows = table(spark, d, "orders").select(F.lit("DUPLICATE").alias("rule_code"), F.lit(1).alias("rule_version"), F.col("o_custkey").alias("loan_id"), F.col("o_orderkey").alias("raw_record_id"), F.lit("HIGH").alias("severity"), F.lit(None).cast("string").alias("field_name"), F.lit("m").alias("message"), F.when(F.col("o_totalprice") > 200000, "fail").otherwise("pass").alias("result"))
    return validate.exceptions_of(rows, "loan_id").groupBy("rule_code", "loan_id", "raw_record_id", "exception_id").count().select("rule_code", "loan_id", "raw_record_id")


@register(f"WITH {_QUEUE_SQL} SELECT rule_code, CASE WHEN id % 7 = 0 THEN 'human_edit' WHEN id % 2 = 0 THEN 'loan_tape' ELSE 'servicer_update' END AS src, count(*) AS n FROM q WHERE exception_type = 'validation_failure' AND rule_code IS NOT NULL GROUP BY ALL")
def recovered_sources(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    e = _queue(spark, d).withColumn("raw_record_id", F.when(F.col("id") % 7 != 0, F.col("id")))
    raw = orders.select(F.col("o_orderkey").alias("raw_record_id"), (F.col("o_orderkey") % 2).alias("raw_file_id"))
    files = spark.createDataFrame([(0, "loan_tape"), (1, "servicer_update")], "raw_file_id long, file_kind string")
    return reconcile.recovered_sources(e, e.select("rule_code"), raw, files)


@register(f"WITH {_QUEUE_SQL} SELECT c_name AS business_id, field_name, count(*) AS n FROM q JOIN customer ON c_custkey = k WHERE exception_type = 'source_conflict' GROUP BY ALL")
def conflict_keys(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.conflict_keys(_queue(spark, d), _customers(spark, d).withColumnRenamed("borrower_id", "business_id"))


@register(f"WITH {_QUEUE_SQL} SELECT DISTINCT c_name AS business_id FROM q JOIN customer ON c_custkey = k WHERE rule_code = 'RULE_2'")
def bad_numeric_loans(spark: SparkSession, d: str) -> DataFrame:
    e = _queue(spark, d).withColumn("rule_code", F.when(F.col("rule_code") == "RULE_2", "INVALID_NUMERIC_FORMAT"))
    return reconcile.bad_numerics(e, _customers(spark, d).withColumnRenamed("borrower_id", "business_id"))


@register(f"WITH {_QUEUE_SQL} SELECT id AS exception_id, c_name AS borrower_id, CASE WHEN rule_code = 'RULE_1' THEN 'first' END AS explanation, CASE WHEN id % 5 = 0 THEN 'Ann' END AS assignee FROM q LEFT JOIN customer ON c_custkey = k")
def exception_page(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("RULE_1", "first")], "rule_code string, explanation string")
    users = spark.createDataFrame([(0, "Ann")], "user_id long, name string")
    return views.enriched(_queue(spark, d).withColumn("assigned_to", F.col("id") % 5), _customers(spark, d), rules, users).select("exception_id", "borrower_id", "explanation", "assignee")


@register("SELECT o_custkey AS exception_id, max(o_orderkey) AS recommendation_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 GROUP BY 1")
def newest_usable_suggestion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("exception_id"), k.alias("recommendation_id"), F.when(F.col("o_orderstatus") != "P", "rate").alias("suggested_field"), F.when(k % 3 == 0, "").otherwise("1").alias("suggested_value"), k.alias("created_at"))
    return assist.newest_usable(rows).select("exception_id", "recommendation_id")


#: English, and the same complaint turned round in SQL, over the columns that stand for the fields.
_ENGLISH = {
    "principal is missing": "CASE WHEN o_totalprice IS NULL THEN false ELSE true END",
    "payment status is not one of O, F": "o_orderstatus IN ('O', 'F')",
    "payment status in (O, P)": "o_orderstatus NOT IN ('O', 'P')",
    "payment status isn't F": "o_orderstatus = 'F'",
    "principal is not at least 50,000": "o_totalprice >= 50000",
    "principal exceeds 150,000 and payment status equals P": "o_totalprice <= 150000 AND o_orderstatus <> 'P'",
}


@register(_verdict_sql({f"R{i}": sql for i, sql in enumerate(_ENGLISH.values())}, "orders"))
def english_rules(spark: SparkSession, d: str) -> DataFrame:
    """Gaps, lists, negations, comparisons and several clauses."""
    rules = []
    for i, text in enumerate(_ENGLISH):
        drafted = english.draft(text).condition.to_json().replace("original_principal", "o_totalprice").replace("payment_status", "o_orderstatus")
        rules.append(Rule(f"R{i}", "LOW", "", Condition.from_json(drafted)))
    return _tally(table(spark, d, "orders"), rules)


def _edited(spark: SparkSession, d: str) -> DataFrame:
    """Records of edits over orders: the even ones change the principal, the odd ones the status."""
    even = F.col("o_orderkey") % 2 == 0
    edits = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.col("o_orderkey").alias("decision_id"), F.col("o_orderkey").alias("decided_at"), F.when(even, "original_principal").otherwise("payment_status").alias("field_name"), F.when(even, F.col("o_totalprice").cast("string")).otherwise("current").alias("value"))
    before = table(spark, d, "customer").select(F.col("c_custkey").alias("loan_id"), F.when(F.col("c_custkey") % 2 == 0, "human_override").otherwise("loan_tape").alias("source_system"), F.lit(2).alias("version"))
    return resolve.human_records(edits, before)


@register("SELECT o_custkey AS loan_id, o_orderkey AS decision_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0 END AS version, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS principal FROM orders")
def human_edit_records(spark: SparkSession, d: str) -> DataFrame:
    return _edited(spark, d).select("loan_id", "decision_id", "version", F.col("data.original_principal").alias("principal"))


@register("SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'not_applicable' WHEN o_totalprice > 150000 THEN 'fail' ELSE 'pass' END AS result, count(*) AS n FROM orders GROUP BY 1")
def human_edit_revalidated(spark: SparkSession, d: str) -> DataFrame:
    """The same rules on edited values alone; fields that weren't edited are out of scope."""
    rule = Rule("R", "LOW", "", english.draft("principal exceeds 150,000").condition)
    results = validate.validate_records(_edited(spark, d), [rule], "2026-08-28T12:00:00", ("human_edit",))
    return results.groupBy("result").agg(F.count(F.lit(1)).alias("n"))
