"""The engine's edges as queries: files it reads and writes, contexts of rules, read views over all loans, the assistant's texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Rule
from ..operators import assist, detect, resolve, trust, validate
from ..operators.conditions import Condition, call, fields, plain, source_system
from ..sources import landing_table, tapes
from ..sources.landing_table import LandingTable, Upload
from ..sources.shared import new_path
from ..sources.tables import table
from . import views
from .queries import _BLEND_SQL, _EXCEPTIONS_SQL, CLOCK, _sources, _tally, _verdict_sql, register
from .state_queries import _as_records
from .view_queries import _QUEUE_SQL, _VERIFIED_SQL, _customers, _queue, _verified

f = fields()


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- files -------------------------------------------------------------------------------------


def _landed(spark: SparkSession, lines: DataFrame, header: str) -> LandingTable:
    """Lines (key, line) as CSV files with a header each, landed in a table of their own."""

    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"line": [header]})
        for batch in batches:
            yield batch[["line"]]

    folder = new_path(spark, "tapes")
    lines.repartition(4, "key").sortWithinPartitions("key").mapInPandas(with_header, "line string").write.text(f"{folder}/files")
    raw = LandingTable(spark, f"{folder}/raw")
    uploads = [Upload(f"{folder}/files/{n}.txt", "loan_tape") for n in landing_table.names_in(spark, f"{folder}/files", ".txt")]
    raw.land(uploads)
    raw.land(uploads)  # nothing comes twice
    return raw


def _ragged(spark: SparkSession, d: str) -> LandingTable:
    """Customers as lines with quoted commas, marks and blank lines; every seventh is too short, every eleventh too long."""
    k = F.col("c_custkey")
    loan = F.concat(F.lit("LN-"), k.cast("string"))
    good = F.concat(loan, F.lit(',"C, ""'), k.cast("string"), F.lit('""",'), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.when(k % 13 == 0, "\n").otherwise(""))
    line = F.when(k % 7 == 0, loan).when(k % 11 == 0, F.concat(loan, F.lit(',n,1,x,"y,z"'))).otherwise(good)
    return _landed(spark, table(spark, d, "customer").select(k.alias("key"), line.alias("line")), "﻿loan_id,borrower_name,servicer_name")


_RAGGED_SQL = """lines AS (SELECT c_custkey AS k, 'LN-' || c_custkey AS loan_id, CASE WHEN c_custkey % 7 = 0 THEN 'missing column(s): borrower_name,servicer_name' WHEN c_custkey % 11 = 0 THEN '2 extra column(s) beyond header' END AS parse_error,
  'C, "' || c_custkey || '"' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS servicer FROM customer)"""


@register(f"WITH {_RAGGED_SQL} SELECT loan_id, parse_error, 'OriginationCore' AS source_system, CASE WHEN parse_error IS NULL THEN name END AS borrower_name, CASE WHEN parse_error IS NULL THEN servicer END AS servicer_name FROM lines")
def tape_landed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of CSV files as they land: quotes, a byte-order mark, blank cells and lines, ragged rows with what is wrong with them."""
    cell = lambda c: F.when(F.col("parse_error").isNull(), F.col("payload")[c]).alias(c)
    return _ragged(spark, d).rows().select(F.col("payload")["loan_id"].alias("loan_id"), "parse_error", "source_system", cell("borrower_name"), cell("servicer_name"))


@register(
    f"""WITH {_RAGGED_SQL} SELECT 'rows' AS what, count(*) AS n FROM lines UNION ALL SELECT 'failed', count(parse_error) FROM lines UNION ALL SELECT 'hundred', 0
      UNION ALL SELECT 'shown', least(200, count(parse_error)) FROM lines"""
)
def files_reported(spark: SparkSession, d: str) -> DataFrame:
    """Counters and progress of the files, and the failed rows that the file view shows (the limit is the view's)."""
    raw = _ragged(spark, d)
    files = views.files_list(raw.manifest().withColumn("uploaded_at", F.col("batch_no")).withColumn("status", F.lit("processing")))
    sums = files.agg(F.sum("row_count").alias("rows"), F.sum("failed_count").alias("failed"), F.count_if(F.col("progress") == 100).alias("hundred"))
    none = spark.createDataFrame([], "raw_record_id string, severity string, exception_type string")
    whole = raw.rows().withColumn("raw_file_id", F.lit("all"))
    shown = views.file_detail("all", whole, none)["failed"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("shown").alias("what"), "n")
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("rows", "failed", "hundred"))))).unionByName(shown)


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a tape whose cells are blank, malformed or padded by turns, one column under an old name and one unknown."""
    k = F.col("c_custkey")
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (k % len(options) + 1).cast("int"))
    cells = [
        F.when(k % 17 == 0, "   ").otherwise(F.concat(F.lit(" LN-"), k.cast("string"))), pick("2024-05-06T07:08:09Z", "2024-05-06", "", "soon"), F.when(k % 5 == 0, '"1,000"').otherwise(k.cast("string")),
        F.when(k % 3 == 0, "2024-13-01").otherwise("2024-05-06"), pick("720.5", "720.0"), pick("Current", " 30-59 Days ", "Strange", ""), F.lit("note"),
    ]
    rows = table(spark, d, "customer").select(k.alias("key"), F.concat_ws(",", *cells).alias("line"))
    return landing_table.records(_landed(spark, rows, " loan_id ,received_date,original_principal,origination_date,credit_score,payment_status,notes"))


@register(
    """SELECT 'LN-' || c_custkey AS loan_id, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS principal, CASE WHEN c_custkey % 3 <> 0 THEN '2024-05-06' END AS originated, CASE WHEN c_custkey % 2 = 1 THEN 720 ELSE -1 END AS score,
      CASE c_custkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'dpd_30_59' WHEN 2 THEN 'strange' END AS status, CASE c_custkey % 4 WHEN 0 THEN 1714979289 WHEN 1 THEN 1714953600 ELSE -1 END AS effective,
      array_to_string([x FOR x IN [CASE WHEN c_custkey % 2 = 0 THEN 'credit_score=720.5/int' END, CASE WHEN c_custkey % 4 = 3 THEN 'last_updated_at=soon/ts' END, CASE WHEN c_custkey % 5 = 0 THEN 'original_principal=1,000/float' END,
        CASE WHEN c_custkey % 3 = 0 THEN 'origination_date=2024-13-01/date' END] IF x IS NOT NULL], ';') AS errors, 'credit_score,last_updated_at,loan_id,original_principal,origination_date,payment_status' AS in_scope
      FROM customer WHERE c_custkey % 17 <> 0"""
)
def tape_records(spark: SparkSession, d: str) -> DataFrame:
    """Typed records of the files: what each cell says, what was wrong with it, and what the file declares."""
    records = _typed(spark, d)[0]
    errors = F.array_sort(F.transform(F.map_entries("field_errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["raw"], F.lit("/"), e["value"]["expected"])))
    named = F.array_join(errors, ";")
    return records.select(
        "data.loan_id", F.col("data.original_principal").alias("principal"), F.col("data.origination_date").alias("originated"), F.coalesce(F.col("data.credit_score"), F.lit(-1)).cast("int").alias("score"), F.col("data.payment_status").alias("status"),
        F.coalesce(F.unix_timestamp("effective_at"), F.lit(-1)).cast("int").alias("effective"), named.alias("errors"), F.array_join(F.array_sort("in_scope"), ",").alias("in_scope"),
    )


@register("SELECT 'import_error' AS exception_type, 'HIGH' AS severity, true AS is_blocking, 'loan_id' AS field_name, count(*) AS n FROM customer WHERE c_custkey % 17 = 0 HAVING count(*) > 0")
def tape_quarantined(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d)[1].groupBy("exception_type", "severity", "is_blocking", "field_name").agg(F.count(F.lit(1)).alias("n"))


@register(
    """SELECT 'csv' AS format, CAST(c_custkey AS VARCHAR) AS loan_id, CAST(c_nationkey AS VARCHAR) AS trust, c_mktsegment AS segment FROM customer
      UNION ALL SELECT 'json', CAST(c_custkey AS VARCHAR), CAST(c_nationkey + 100 AS VARCHAR), c_mktsegment FROM customer"""
)
def exports_written(spark: SparkSession, d: str) -> DataFrame:
    """Files that were written, read again: in CSV the canonical value of a shared name goes first, in JSON the fixed one."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("loan_id"), (F.col("c_nationkey") + 100).alias("trust"), F.struct(F.col("c_nationkey").alias("trust"), F.col("c_mktsegment").alias("segment")).alias("data"))
    folder = new_path(spark, "exports")
    tapes.export_csv(rows, ["loan_id", "trust"], "data", f"{folder}/csv")
    tapes.export_json(rows, ["loan_id", "trust"], "data", f"{folder}/json")
    parts = [spark.read.option("header", True).csv(f"{folder}/csv"), spark.read.schema("loan_id string, trust string, segment string").json(f"{folder}/json")]
    return _union(*(p.select(F.lit(name).alias("format"), *(F.col(c).cast("string").alias(c) for c in ("loan_id", "trust", "segment"))) for name, p in zip(("csv", "json"), parts, strict=True)))


# --- rules -----------------------------------------------------------------------------------------

_CONTEXT_SQL = "(SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders)"


@register(
    _verdict_sql(
        {
            "BATCH": "CAST(NULL AS BOOLEAN)", "CASES": "lower(upper(p)) = '1-urgent' OR s <> 'F'", "DIFFERENCE": "CASE WHEN s IS NOT NULL THEN true END", "ERROR": "false",
            "SOURCE": "s <> 'O'", "SUMS": "(o_totalprice + 10) * 2 - o_totalprice / 4 <= 300000",
        },
        _CONTEXT_SQL,
    )
)
def rule_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The record's source, a batch that is never known, values that exist, cells that were malformed, letters and sums."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    rules = [
        Rule("SOURCE", "LOW", "", source_system().differs("O")), Rule("BATCH", "LOW", "", Condition({"type": "context", "name": "batch_id"}).equals("x")), Rule("DIFFERENCE", "LOW", "", call("not_null", f.s.lower())),
        Rule("ERROR", "LOW", "", f.o_totalprice.malformed()), Rule("CASES", "LOW", "", Condition({"type": "or", "operands": [f.p.upper().lower().equals("1-urgent").node, f.s.differs("F").node]})),
        Rule("SUMS", "LOW", "", (f.o_totalprice + 10) * 2 - f.o_totalprice / 4 <= 300000),
    ]
    return _tally(rows, rules, F.col("s"))


@register("SELECT p_partkey, p_retailprice FROM part WHERE NOT (p_retailprice >= 1200 OR p_size < 10) ORDER BY p_partkey DESC LIMIT 20")
def rule_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first failing rows of a dry run: twenty by nature."""
    rows = table(spark, d, "part").withColumn("_o", -F.col("p_partkey"))
    condition = Condition({"type": "or", "operands": [(f.p_retailprice >= 1200).node, (f.p_size < 10).node]})
    return validate.preview(rows, condition, plain(rows, CLOCK), ["_o"])[1].select("p_partkey", "p_retailprice")


_DATASET_RULES = [
    Rule("DUPLICATE", "HIGH", "", check={"check": "duplicate_key", "keys": ["loan_id"], "partition_by": "raw_file_id"}),
    Rule("FINGERPRINT", "HIGH", "", check={"check": "fingerprint_duplicate", "keys": ["borrower_name", "original_principal"]}),
    Rule("BURST", "MEDIUM", "", check={"check": "repeat_pattern", "key": "borrower_id", "count_gt": 3, "window_days": 90}),
]
_DATASET_SQL = """base AS (SELECT o_orderkey AS k, 'LN-' || o_custkey AS loan, o_orderkey % 4 AS file, o_orderpriority AS name, floor(o_totalprice / 1000) AS p, CAST(o_orderdate AS DATE) AS day, o_custkey AS who FROM orders),
  prints AS (SELECT name, p, count(DISTINCT loan) AS loans FROM base GROUP BY ALL),
  ahead AS (SELECT *, count(*) OVER (PARTITION BY who ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 90 DAY FOLLOWING) AS c FROM base),
  verdicts AS (SELECT 'DUPLICATE' AS rule_code, loan, CASE WHEN count(*) OVER (PARTITION BY loan, file) > 1 THEN 'fail' ELSE 'pass' END AS result FROM base
    UNION ALL SELECT 'FINGERPRINT', loan, CASE WHEN loans > 1 THEN 'fail' ELSE 'pass' END FROM base JOIN prints USING (name, p)
    UNION ALL SELECT 'BURST', loan, CASE WHEN max(c) OVER (PARTITION BY who ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) > 3 THEN 'fail' ELSE 'pass' END FROM ahead)"""


@register(f"WITH {_DATASET_SQL} SELECT rule_code, count(*) FILTER (result = 'pass') AS passed, count(*) FILTER (result = 'fail') AS failed, count(DISTINCT loan) FILTER (result = 'fail') AS exceptions FROM verdicts GROUP BY rule_code")
def dataset_rules(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates within a file, clones under other ids and bursts, run as rules over records; an exception for each rule and loan."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("LN-"), F.col("o_custkey").cast("string")).alias("loan_id"), F.lit("core").alias("source_system"), k.alias("version"), F.col("o_custkey").cast("string").alias("borrower_id"), F.col("o_orderpriority").alias("borrower_name"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("original_principal"), F.to_date("o_orderdate").cast("string").alias("origination_date"), (k % 4).cast("string").alias("raw_file_id"),
    )
    files = rows.select(F.concat_ws("/", "loan_id", "source_system", F.col("version").cast("string")).alias("raw_record_id"), "raw_file_id")
    records = _as_records(rows.drop("raw_file_id")).join(files, "raw_record_id")
    results = validate.validate_dataset(records, _DATASET_RULES)
    counts = results.groupBy("rule_code").agg(F.count_if(F.col("result") == "pass").alias("passed"), F.count_if(F.col("result") == "fail").alias("failed"))
    found = validate.exceptions_of(results, "loan_id").groupBy("rule_code").agg(F.count(F.lit(1)).alias("exceptions"))
    return counts.join(found, "rule_code", "left").withColumn("exceptions", F.coalesce("exceptions", F.lit(0).cast("long")))


@register(
    """WITH a AS (SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS st FROM customer), b AS (SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) / 50 AS balance, CASE WHEN o_custkey % 2 = 0 THEN 'BUILDING' ELSE arg_max(o_orderpriority, o_orderkey) END AS st, max(o_orderkey) AS v FROM orders GROUP BY 1)
      SELECT k AS loan_id, 'current_balance' AS field_name, 'MEDIUM' AS severity, false AS is_blocking, k || '/ServicerFeed/' || v AS raw_record_id FROM a JOIN b USING (k) WHERE abs(a.balance - b.balance) > 500 AND abs(a.balance - b.balance) / greatest(abs(a.balance), abs(b.balance), 1.0) >= 0.01
      UNION ALL SELECT k, 'payment_status', 'MEDIUM', false, k || '/ServicerFeed/' || v FROM a JOIN b USING (k) WHERE a.st <> b.st"""
)
def conflict_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Latest records of two sources that disagree, as exceptions filed with the second source."""
    core = table(spark, d, "customer").select(F.col("c_custkey").alias("loan_id"), F.lit("OriginationCore").alias("source_system"), F.lit(1).cast("long").alias("version"), F.col("c_acctbal").alias("current_balance"), F.col("c_mktsegment").alias("payment_status"))
    st = F.when(F.col("o_custkey") % 2 == 0, "BUILDING").otherwise(F.col("o_orderpriority"))
    feed = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.lit("ServicerFeed").alias("source_system"), F.col("o_orderkey").alias("version"), (F.col("o_totalprice") / 50).alias("current_balance"), st.alias("payment_status"))
    return detect.source_conflicts(_as_records(core.unionByName(feed))).select("loan_id", "field_name", "severity", "is_blocking", "raw_record_id")


# --- read views --------------------------------------------------------------------------------------


@register(
    f"""WITH {_QUEUE_SQL}, {_VERIFIED_SQL}, waiting AS (SELECT k, count(*) AS n FROM q WHERE status = 'open' GROUP BY 1), t AS (SELECT loan_id, max(trust_score) AS best, arg_max(trust_score, version) AS latest FROM v GROUP BY 1),
      src AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1)
      SELECT c_custkey AS loan_id, n AS open_exceptions, latest AS trust_score, sources FROM customer JOIN waiting ON k = c_custkey JOIN t ON t.loan_id = c_custkey JOIN src ON src.k = c_custkey WHERE urgent AND best <= 60"""
)
def loan_browser_open(spark: SparkSession, d: str) -> DataFrame:
    """Loans with open exceptions, from one source, under a trust."""
    records = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.col("o_orderpriority").alias("source_system"))
    out = views.loans(_customers(spark, d), _queue(spark, d), _verified(spark, d), records, open_exceptions=True, source="1-URGENT", trust_max=60)
    return out.select("loan_id", F.col("open_exceptions").cast("long").alias("open_exceptions"), "trust_score", F.array_join("sources", ",").alias("sources"))


@register(f"WITH {_QUEUE_SQL} SELECT id AS exception_id, (SELECT count(*) FROM q WHERE severity = 'HIGH') AS total_rows, (SELECT (count(*) + 19) // 20 FROM q WHERE severity = 'HIGH') AS total_pages FROM q WHERE severity = 'HIGH' ORDER BY id DESC LIMIT 20 OFFSET 40")
def exceptions_paged(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a filtered queue, with how much there is in all."""
    rows = views.filtered(_queue(spark, d), severity="HIGH").select("exception_id")
    return views.paged(rows, [F.desc("exception_id")], 3, 20).select("exception_id", "total_rows", "total_pages")


@register(
    f"""WITH {_QUEUE_SQL}, streams AS (SELECT o_custkey AS k, 'record' AS kind, 0 AS o, o_orderkey AS ref, epoch_us(o_orderdate) AS at_us FROM orders UNION ALL SELECT q.k, 'exception', 1, q.id, epoch_us(o_orderdate) FROM q JOIN orders ON o_orderkey = q.id
        UNION ALL SELECT q.k, 'decision', 2, q.id, epoch_us(o_orderdate) + 86400000000 FROM q JOIN orders ON o_orderkey = q.id WHERE q.status <> 'open' UNION ALL SELECT user_id, 'version', 3, event_id, epoch_us(ts) FROM events)
      SELECT k AS loan_id, kind, ref, CAST(row_number() OVER (PARTITION BY k ORDER BY at_us, o, ref) AS INTEGER) AS place FROM streams"""
)
def loan_timelines(spark: SparkSession, d: str) -> DataFrame:
    """Records, exceptions, decisions and versions of every loan in one order of time."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.col("o_orderkey").alias("ref"), "o_orderdate")
    found = _queue(spark, d).select("loan_id", F.col("id").alias("ref"), "status").join(orders.select("ref", "o_orderdate"), "ref")
    said = found.filter("status <> 'open'").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    versions = table(spark, d, "events").select(F.col("user_id").alias("loan_id"), F.col("event_id").alias("ref"), "ts")
    return views.timelines("loan_id", ("record", orders, "o_orderdate"), ("exception", found, "o_orderdate"), ("decision", said, "o_orderdate"), ("version", versions, "ts")).select("loan_id", "kind", "ref", "place")


@register(
    f"""WITH {_QUEUE_SQL}, {_VERIFIED_SQL} SELECT 'record' AS part, o_custkey AS loan_id, o_orderpriority AS what, max(o_orderkey) AS n FROM orders GROUP BY ALL
      UNION ALL SELECT 'exception', k, exception_type || '/' || severity || '/' || status, count(*) FROM q GROUP BY ALL
      UNION ALL SELECT 'passed', o_custkey, 'pass', count(*) FILTER (o_totalprice <= 120000) FROM orders GROUP BY 2 UNION ALL SELECT 'failed', o_custkey, 'fail', count(*) FILTER (o_totalprice > 120000) FROM orders GROUP BY 2
      UNION ALL SELECT 'version', loan_id, 'latest', max(version) FROM v GROUP BY 2"""
)
def loan_details(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every loan's page."""
    orders = table(spark, d, "orders")
    records = orders.select(F.col("o_custkey").alias("loan_id"), F.col("o_orderpriority").alias("source_system"), F.col("o_orderkey").alias("version"))
    results = orders.select(F.col("o_custkey").alias("loan_id"), F.when(F.col("o_totalprice") <= 120000, "pass").otherwise("fail").alias("result"))
    parts = views.details(records, _queue(spark, d), results, _verified(spark, d))
    row = lambda df, part, what, n: df.select(F.lit(part).alias("part"), "loan_id", what.alias("what"), n.cast("long").alias("n"))
    return _union(
        row(parts["records"], "record", F.col("source_system"), F.col("version")), row(parts["exceptions"], "exception", F.concat_ws("/", "exception_type", "severity", "status"), F.col("n")),
        row(parts["validation"], "passed", F.lit("pass"), F.col("pass")), row(parts["validation"], "failed", F.lit("fail"), F.col("fail")),
        row(parts["verified"].groupBy("loan_id").agg(F.max("version").alias("v")), "version", F.lit("latest"), F.col("v")),
    )


@register(
    f"""WITH {_QUEUE_SQL}, r AS (SELECT o_custkey AS k, 'RULE_' || (o_orderkey % 3) AS rule_code, CASE WHEN arg_max(o_totalprice, o_orderkey) <= 120000 THEN 'pass' ELSE 'fail' END AS result FROM orders GROUP BY ALL)
      SELECT id AS exception_id, result, CASE WHEN id % 5 < 2 THEN 2 WHEN id % 5 = 2 THEN 1 ELSE 0 END AS recommendations FROM q LEFT JOIN r USING (k, rule_code)"""
)
def exception_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every exception with its rule's newest verdict on the loan and its recommendations."""
    k = F.col("o_orderkey")
    results = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.concat(F.lit("RULE_"), (k % 3).cast("string")).alias("rule_code"), F.when(F.col("o_totalprice") <= 120000, "pass").otherwise("fail").alias("result"), k.alias("evaluated_at"))
    queue = _queue(spark, d)
    times = F.when(F.col("id") % 5 < 2, 2).when(F.col("id") % 5 == 2, 1).otherwise(0)
    said = queue.select("exception_id", F.explode(F.array_repeat(F.lit(1), times)))
    return views.exception_details(queue, results, said).select("exception_id", "result.result", F.col("recommendations").cast("int").alias("recommendations"))


@register(
    """SELECT 'type' AS part, event_type AS value, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'actor', CASE user_id % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'ai' ELSE 'system' END, count(*) FROM events GROUP BY 2
      UNION ALL SELECT 'latest', arg_max(event_type, event_id), count(*) FROM events"""
)
def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    actor = F.element_at(F.array(*map(F.lit, ("human", "ai", "system"))), (F.col("user_id") % 3 + 1).cast("int"))
    parts = views.audit_stats(table(spark, d, "events").select("event_type", F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), actor.alias("actor_type")))
    row = lambda df, part, value, n: df.select(F.lit(part).alias("part"), F.col(value).alias("value"), F.col(n).alias("n"))
    return _union(row(parts["by_type"], "type", "event_type", "n"), row(parts["by_actor"], "actor", "actor_type", "n"), row(parts["latest"], "latest", "last_type", "events"))


@register(f"WITH {_VERIFIED_SQL} SELECT count(*) AS n, count(DISTINCT loan_id) AS loans, CAST(round(avg(trust_score) * 1000) AS BIGINT) AS mean_1000 FROM v")
def dashboard_verified(spark: SparkSession, d: str) -> DataFrame:
    """How much is verified, and the mean trust over all versions."""
    none = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.lit("s").alias("source_system"), F.lit("pass").alias("result"))
    out = views.dashboard(_customers(spark, d), _queue(spark, d), _verified(spark, d), none, none)["verified"]
    return out.select("n", "loans", F.round(F.col("mean_trust") * 1000).cast("long").alias("mean_1000"))


@register("SELECT o_custkey AS loan_id, max(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def sources_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """What each source says of every loan, in columns."""
    records = table(spark, d, "orders").select(F.col("o_custkey").alias("loan_id"), F.col("o_orderpriority").alias("source_system"), "o_totalprice")
    return views.by_source(records, "loan_id", "o_totalprice", ["1-URGENT", "5-LOW"]).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@register("SELECT DISTINCT o_custkey AS loan_id, 'f' || (o_orderkey % 9) AS raw_file_id, sha256('f' || (o_orderkey % 9)) AS sha256 FROM orders WHERE o_orderkey % 7 <> 0")
def lineage_files(spark: SparkSession, d: str) -> DataFrame:
    """The files behind every loan, from record to raw row to file; records without a raw row lead nowhere."""
    k = F.col("o_orderkey")
    file = F.concat(F.lit("f"), (k % 9).cast("string"))
    orders = table(spark, d, "orders")
    records = orders.select(F.col("o_custkey").alias("loan_id"), F.when(k % 7 != 0, k).alias("raw_record_id"))
    raw = orders.select(k.alias("raw_record_id"), file.alias("raw_file_id"))
    files = raw.select("raw_file_id").distinct().withColumn("sha256", F.sha2("raw_file_id", 256))
    return trust.source_files(records, raw, files, "loan_id")


# --- the assistant and decisions ------------------------------------------------------------------------


@register(
    f"""WITH {_BLEND_SQL} SELECT k, fld AS field_name, string_agg('"' || src || '":"' || v || '"', ',' ORDER BY src) AS evidence FROM cells WHERE v IS NOT NULL GROUP BY ALL"""
)
def evidence_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The last version's value of each source, by loan and field."""
    rows = _sources(spark, d)
    cells = rows.select("k", "source_system", "version", F.inline(F.filter(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("balance", "segment"))), lambda x: x["value"].isNotNull())))
    return assist.evidence(cells, "k").select("k", "field_name", F.regexp_replace(F.to_json("evidence"), "^.|.$", "").alias("evidence"))


@register(
    f"""WITH {_EXCEPTIONS_SQL}, e AS (SELECT *, CASE WHEN id % 5 = 2 AND rule_code IS NOT NULL THEN 'DUPLICATE_' || rule_code ELSE rule_code END AS code FROM exc)
      SELECT id, CASE WHEN field_name IS NULL AND code LIKE 'DUPLICATE\\_%' ESCAPE '\\' THEN 'The check over the whole table ''' || code || ''' flagged this record; no single field is at fault.'
        ELSE 'Field ''' || coalesce(field_name, 'unknown') || ''' has a problem of kind ' || exception_type || '.' END AS problem,
      '[' || severity || '] ' || exception_type || ' ' || coalesce(code, 'no rule') || ' on ' || coalesce(field_name, 'the record') || ' (' || status || ')' AS note FROM e"""
)
def assistant_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong in one sentence, and the note for a reviewer."""
    e = _queue_plain(spark, d)
    return e.select("id", assist.problem(F.col("code"), F.col("field_name"), F.col("exception_type")).alias("problem"), assist.reviewer_note(F.col("exception_type"), F.col("code"), F.col("field_name"), F.col("severity"), F.col("status")).alias("note"))


def _queue_plain(spark: SparkSession, d: str) -> DataFrame:
    from .queries import _exceptions

    code = F.when((F.col("id") % 5 == 2) & F.col("rule_code").isNotNull(), F.concat(F.lit("DUPLICATE_"), "rule_code")).otherwise(F.col("rule_code"))
    return _exceptions(spark, d).withColumn("code", code)


@register(
    """SELECT user_id AS exception_id, event_type AS action_type, max(event_id) AS recommendation_id, count(*) - 1 AS earlier_runs FROM events GROUP BY ALL"""
)
def recommendations_newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest recommendation of each kind, and how many were made before."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("exception_id"), F.col("event_type").alias("action_type"), F.col("event_id").alias("recommendation_id"), F.col("event_id").alias("created_at"))
    return assist.newest_recommendation(rows).select("exception_id", "action_type", "recommendation_id", "earlier_runs")


@register(
    """SELECT o_orderkey AS decision_id, CASE WHEN o_orderkey % 5 = 0 THEN 'no' WHEN o_orderkey % 2 = 0 AND o_orderstatus IN ('O', 'F') THEN 'yes' ELSE 'unsaid' END AS agreed, o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS sent_back FROM orders"""
)
def decisions_told(spark: SparkSession, d: str) -> DataFrame:
    """Whether a reviewer agreed with what was recommended, and which loans went back."""
    k = F.col("o_orderkey")
    action = F.when(F.col("o_orderstatus") == "O", "accept").when(F.col("o_orderstatus") == "F", "edit").otherwise("reject")
    rows = table(spark, d, "orders").select(k.alias("decision_id"), k.alias("loan_id"), action.alias("action"), F.when(k % 2 == 0, k).alias("cited"), F.when(k % 5 == 0, False).alias("stated"), (k % 3 == 0).alias("request_correction"))
    back = resolve.corrections_requested(rows).select("loan_id", F.lit(True).alias("sent_back"))
    agreed = resolve.agreement(F.col("cited"), F.col("action"), F.col("stated"))
    return rows.join(back, "loan_id", "left").select("decision_id", F.when(agreed, "yes").when(~agreed, "no").otherwise("unsaid").alias("agreed"), F.coalesce("sent_back", F.lit(False)).alias("sent_back"))


@register(
    """WITH first AS (SELECT o_custkey % 50 AS h, count(*) FILTER (o_orderstatus <> 'P') AS good, max(o_orderkey) FILTER (o_orderstatus <> 'P') AS newest FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
      SELECT 'fresh' AS part, o_orderkey AS id, -1 AS latest FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 50 NOT IN (SELECT h FROM first WHERE good > 0)
      UNION ALL SELECT 'newest', h, newest FROM first WHERE good > 0 UNION ALL SELECT 'unread', o_orderkey, -1 FROM orders WHERE o_orderkey % 7 NOT IN (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_linenumber < 5)"""
)
def uploads_known(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content is new, the newest upload of each content, and raw rows of files that have no records yet."""
    orders = table(spark, d, "orders")
    k = F.col("o_orderkey")
    files = orders.select(k.alias("raw_file_id"), (F.col("o_custkey") % 50).alias("sha256"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), k.alias("uploaded_at"))
    registry = files.filter("raw_file_id % 3 = 0")
    fresh = tapes.not_seen(files.filter("raw_file_id % 3 = 1"), registry).select(F.lit("fresh").alias("part"), F.col("raw_file_id").alias("id"), F.lit(-1).cast("long").alias("latest"))
    newest = tapes.latest_upload(registry).select(F.lit("newest").alias("part"), F.col("sha256").alias("id"), F.col("raw_file_id").alias("latest"))
    raw = orders.select(k.alias("id"), (k % 7).cast("int").alias("raw_file_id"))
    done = table(spark, d, "lineitem").filter("l_linenumber < 5").select(F.col("l_linenumber").cast("int").alias("raw_file_id"))
    unread = tapes.once_per_file(raw, done).select(F.lit("unread").alias("part"), "id", F.lit(-1).cast("long").alias("latest"))
    return _union(fresh, newest, unread)
