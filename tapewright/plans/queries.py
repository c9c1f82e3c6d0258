"""The engine's operators as queries over the driver's tables, each with its SQL.

``register`` keeps a query and the SQL that gives the same rows side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Rule, trust_table
from ..functions import coercion
from ..operators import assist, canonical, chain, detect, english, reconcile, resolve, trust, validate
from ..operators.conditions import Condition, all_of, any_of, days_between, fields, now, plain
from ..sources import tapes
from ..sources.tables import table
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Evaluation clock of the queries: a parameter, never the time of execution.
CLOCK = "1998-08-02 12:00:00"
f = fields()


def register(sql: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        ORACLE_SQL[query.__name__] = sql
        return query

    return keep


def _n(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def _tally(rows: DataFrame, rules: list[Rule], source: Column | None = None) -> DataFrame:
    counts = validate.tallied(rows, rules, plain(rows, CLOCK, source))
    pairs = F.array(*(F.struct(F.lit(s).alias("result"), F.col(s).alias("n")) for s in validate.VERDICTS))
    return counts.select("rule_code", F.inline(pairs)).filter("n > 0")


def _verdict_sql(rules: dict[str, str], source: str) -> str:
    """Counts of verdicts of boolean SQL conditions."""
    one = "SELECT '{code}' AS rule_code, CASE WHEN v IS NULL THEN 'not_applicable' WHEN v THEN 'pass' ELSE 'fail' END AS result, count(*) AS n FROM (SELECT ({sql}) AS v FROM {source}) GROUP BY ALL"
    return " UNION ALL ".join(one.format(code=c, sql=s, source=source) for c, s in rules.items())


# --- rules --------------------------------------------------------------------------


@register(
    _verdict_sql(
        {
            "CORE_FIELDS": "o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL",
            "PRICE_IN_RANGE": "o_totalprice > 1000 AND o_totalprice <= 200000",
            "STATUS_KNOWN": "o_orderstatus IN ('O', 'F')",
            "URGENT_IS_SMALL": "o_orderpriority <> '1-URGENT' OR o_totalprice <= 150000",
        },
        "orders",
    )
)
def rule_row_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        Rule("CORE_FIELDS", "CRITICAL", "", all_of(f.o_orderkey.given(), f.o_totalprice.given())),
        Rule("PRICE_IN_RANGE", "MEDIUM", "", all_of(f.o_totalprice > 1000, f.o_totalprice <= 200000)),
        Rule("STATUS_KNOWN", "LOW", "", f.o_orderstatus.in_set(["O", "F"])),
        Rule("URGENT_IS_SMALL", "HIGH", "", any_of(~f.o_orderpriority.equals("1-URGENT"), f.o_totalprice <= 150000)),
    ]
    return _tally(table(spark, d, "orders"), rules)


_LINES = "(SELECT nullif(l_quantity, 10) AS q, nullif(l_discount, 0.05) AS d, nullif(l_returnflag, 'A') AS r FROM lineitem)"


@register(_verdict_sql({"AND": "q > 20 AND d <= 0.04", "NOT": "NOT (q > 20)", "OR": "q > 20 OR d <= 0.04 OR r = 'N'"}, _LINES))
def rule_kleene_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.nullif("l_quantity", F.lit(10.0)).alias("q"), F.nullif("l_discount", F.lit(0.05)).alias("d"), F.nullif("l_returnflag", F.lit("A")).alias("r")
    )
    big, low = f.q > 20, f.d <= 0.04
    return _tally(rows, [Rule("AND", "LOW", "", all_of(big, low)), Rule("NOT", "LOW", "", ~big), Rule("OR", "LOW", "", any_of(big, low, f.r.equals("N")))])


@register(
    _verdict_sql({"NUMBER_ORDER_TEXT": "CAST(NULL AS BOOLEAN)", "TEXT_DIFFERS_NUMBER": "CASE WHEN p_size IS NOT NULL THEN true END", "TEXT_IS_NUMBER": "CASE WHEN p_name IS NOT NULL THEN false END"}, "part")
)
def rule_mixed_types(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule("TEXT_IS_NUMBER", "LOW", "", f.p_name.equals(5)), Rule("TEXT_DIFFERS_NUMBER", "LOW", "", f.p_size.differs("5")), Rule("NUMBER_ORDER_TEXT", "LOW", "", f.p_size > "x")]
    return _tally(table(spark, d, "part"), rules)


@register(_verdict_sql({"UNIT_PRICE": "l_extendedprice / nullif(l_quantity - 10, 0) <= 3000"}, "lineitem"))
def rule_arith_absent(spark: SparkSession, d: str) -> DataFrame:
    return _tally(table(spark, d, "lineitem"), [Rule("UNIT_PRICE", "LOW", "", f.l_extendedprice / (f.l_quantity - 10) <= 3000)])


@register(_verdict_sql({"FRESH": f"floor((epoch_us(TIMESTAMP '{CLOCK}') - epoch_us(o_orderdate)) / 86400000000.0) <= 1095"}, "orders"))
def rule_staleness_days(spark: SparkSession, d: str) -> DataFrame:
    return _tally(table(spark, d, "orders"), [Rule("FRESH", "MEDIUM", "", days_between(now(), f.o_orderdate) <= 1095)])


@register(_verdict_sql({"LOWER": "lower(c_mktsegment) IN ('building', 'machinery')", "UPPER": "upper(c_mktsegment) IN ('BUILDING', 'AUTOMOBILE')"}, "customer"))
def rule_set_case(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule("LOWER", "LOW", "", f.c_mktsegment.lower().in_set(["building", "machinery"])), Rule("UPPER", "LOW", "", f.c_mktsegment.upper().in_set(["BUILDING", "AUTOMOBILE"]))]
    return _tally(table(spark, d, "customer"), rules)


@register(
    """SELECT touched, field_name, result, count(*) AS n FROM (
      SELECT CASE WHEN p IS NOT NULL AND NOT p THEN 'o_totalprice' WHEN s IS NOT NULL AND NOT s THEN 'o_orderstatus,o_totalprice' ELSE 'o_orderpriority,o_orderstatus,o_totalprice' END AS touched,
        CASE WHEN p IS NOT NULL AND NOT p THEN 'o_totalprice' END AS field_name,
        CASE WHEN (p AND s AND r) IS NULL THEN 'not_applicable' WHEN p AND s AND r THEN 'pass' ELSE 'fail' END AS result
      FROM (SELECT o_totalprice <= 150000 AS p, nullif(o_orderstatus, 'P') <> 'F' AS s, o_orderpriority <> '1-URGENT' AS r FROM orders)) GROUP BY ALL"""
)
def rule_touched_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    condition = all_of(f.o_totalprice <= 150000, f.o_orderstatus.differs("F"), f.o_orderpriority.differs("1-URGENT"))
    out = validate.run_rules(rows, [Rule("R", "LOW", "", condition)], plain(rows, CLOCK), [])
    return _n(out.withColumn("touched", F.array_join("touched", ",")), "touched", "field_name", "result")


@register("SELECT c_custkey, 'balance ' || CAST(c_acctbal AS VARCHAR) || ' is below zero (—)' AS message FROM customer WHERE c_acctbal < 0")
def rule_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    out = validate.run_rules(rows, [Rule("R", "LOW", "balance {c_acctbal} is below zero ({c_name})", f.c_acctbal >= 0)], plain(rows, CLOCK), ["c_custkey"])
    return out.filter("result = 'fail'").select("c_custkey", "message")


@register("SELECT result, count(*) AS n FROM (SELECT CASE WHEN p_retailprice >= 1200 OR p_size < 10 THEN 'pass' ELSE 'fail' END AS result FROM part) GROUP BY result")
def rule_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return validate.preview(rows, any_of(f.p_retailprice >= 1200, f.p_size < 10), plain(rows, CLOCK), ["p_partkey"])[0]


@register("SELECT 'CUSTOM_O_TOTALPRICE_MAX_150000' AS rule_code, CASE WHEN o_totalprice <= 150000 THEN 'pass' ELSE 'fail' END AS result, count(*) AS n FROM orders GROUP BY ALL")
def nl_rule_applied(spark: SparkSession, d: str) -> DataFrame:
    """A rule from English, with its field bound to a column of the table."""
    drafted = english.draft("original principal above 150,000")
    bound = Condition.from_json(drafted.condition.to_json().replace("original_principal", "o_totalprice"))
    return _tally(table(spark, d, "orders"), [Rule(drafted.code.replace("ORIGINAL_PRINCIPAL", "O_TOTALPRICE"), drafted.severity, "", bound)])


# --- typing ---------------------------------------------------------------------------


@register(
    """SELECT status, count(*) AS n FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'current' WHEN 1 THEN 'dpd_30_59' WHEN 2 THEN 'paid_off' WHEN 3 THEN 'activ' ELSE NULL END AS status FROM orders) GROUP BY ALL"""
)
def normalize_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " Current ").when(k == 1, "30-59 DAYS").when(k == 2, "Paid Off").when(k == 3, "Activ").otherwise("  ")
    return _n(table(spark, d, "orders").select(tapes.coerced("payment_status", raw)[0].alias("status")), "status")


@register(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) ELSE NULL END AS as_double,
      CASE o_orderkey % 4 WHEN 2 THEN o_orderkey ELSE NULL END AS as_long, o_orderkey % 4 IN (1, 3) AS malformed FROM orders"""
)
def normalize_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Plain, currency, whole and separated numbers."""
    k, price, key = F.col("o_orderkey") % 4, F.round("o_totalprice", 2), F.col("o_orderkey")
    text = F.when(k == 0, price.cast("decimal(18,2)").cast("string")).when(k == 1, F.concat(F.lit("$"), price.cast("string"))).when(k == 2, F.concat(key.cast("string"), F.lit(".0"))).otherwise("1,25,000")
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("k"), coercion.stripped(text).alias("s"))
    number, whole = coercion.to_double(F.col("s")), coercion.to_long(F.col("s"))
    return rows.select("o_orderkey", F.when(F.col("k") == 0, number).alias("as_double"), F.when(F.col("k") == 2, whole).alias("as_long"), number.isNull().alias("malformed"))


@register(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, o_orderkey % 3 <> 0 AS malformed FROM orders"
)
def normalize_date(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    value, bad = tapes.coerced("origination_date", text)
    return table(spark, d, "orders").select("o_orderkey", value.alias("iso"), bad.alias("malformed"))


@register("SELECT CASE WHEN o_custkey % 10 = 0 THEN 'quarantined' ELSE 'kept' END AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL")
def quarantine_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows without identity go to quarantine, the others on."""
    key = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string"))
    records = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("raw_record_id"), F.struct(key.alias("loan_id")).alias("data"))
    kept, bad = tapes.quarantined(records)
    both = kept.select(F.lit("kept").alias("part"), "raw_record_id").unionByName(bad.select(F.lit("quarantined").alias("part"), "raw_record_id"))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("raw_record_id").cast("long")).alias("keys"))


@register(
    """SELECT version, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
      SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey)::INTEGER + coalesce(base.top, 0) AS version
      FROM orders LEFT JOIN (SELECT c_custkey, 'F' AS s, c_nationkey AS top FROM customer) base ON c_custkey = o_custkey AND s = o_orderstatus) GROUP BY version"""
)
def version_assign(spark: SparkSession, d: str) -> DataFrame:
    """Running versions on top of those that exist."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.col("c_nationkey").alias("version"))
    out = tapes.versioned(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], base)
    return out.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register("SELECT o_custkey, CAST(min(o_orderdate) AS VARCHAR)[:10] AS first_date FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) GROUP BY o_custkey")
def new_keys(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    found = tapes.new_keys(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderdate", known)
    return found.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_date"))


# --- detectors ------------------------------------------------------------------------


@register(
    """SELECT l_orderkey, l_linenumber, count(*) AS n, bool_or(dup > 1) AS failed FROM (
      SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS dup FROM lineitem) GROUP BY ALL"""
)
def detect_duplicate_key(spark: SparkSession, d: str) -> DataFrame:
    rows = detect.duplicate_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("result") == "fail").alias("failed"))


@register(
    """SELECT result, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 'not_applicable' WHEN g.a <> g.b THEN 'fail' ELSE 'pass' END AS result
      FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY text) g ON g.text = d.text) GROUP BY result"""
)
def detect_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts under different ids, found by their hash."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("print"))
    out = detect.fingerprint_duplicate(rows, ["print"], "doc_id")
    return out.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@register(
    """SELECT result, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
      SELECT o_orderkey, CASE WHEN max(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) > 3 THEN 'fail' ELSE 'pass' END AS result
      FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND INTERVAL 90 DAY FOLLOWING) AS c FROM orders)) GROUP BY result"""
)
def detect_burst(spark: SparkSession, d: str) -> DataFrame:
    out = detect.repeat_pattern(table(spark, d, "orders"), "o_custkey", "o_orderdate", 3, 90)
    return out.groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register(
    """SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS line FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE abs(o_totalprice - line) > 20000 AND abs(o_totalprice - line) / greatest(abs(o_totalprice), abs(line), 1.0) >= 0.5"""
)
def conflict_numeric(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("price"))
    out = detect.conflicts(a, b, "k", ["price"], [], least=20000.0, ratio=0.5)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@register(
    """SELECT value_a, value_b, count(*) AS n FROM (SELECT o_orderstatus AS value_a, s AS value_b FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE o_orderstatus <> s) GROUP BY ALL"""
)
def conflict_categorical(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("s"))
    return _n(detect.conflicts(a, b, "k", [], ["s"]), "value_a", "value_b")


@register("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return detect.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# --- survivorship ------------------------------------------------------------------------

_TRUST = [("core", None, 60), ("core", "balance", 50), ("feed", None, 80), ("feed", "segment", 40), ("list", None, 70)]
_BLEND_SQL = """last_order AS (SELECT o_custkey, o_totalprice AS p, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
  cells AS (
    SELECT c_custkey AS k, 'core' AS src, 'balance' AS fld, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS v FROM customer
    UNION ALL SELECT c_custkey, 'core', 'segment', c_mktsegment FROM customer
    UNION ALL SELECT o_custkey, 'feed', 'balance', CAST(CAST(p AS DECIMAL(12,2)) AS VARCHAR) FROM last_order
    UNION ALL SELECT o_custkey, 'feed', 'segment', o_orderpriority FROM last_order
    UNION ALL SELECT s_suppkey, 'list', 'balance', CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) FROM supplier
    UNION ALL SELECT s_suppkey, 'none', 'segment', s_name FROM supplier),
  trust(src, fld, t) AS (VALUES ('core', NULL, 60), ('core', 'balance', 50), ('feed', NULL, 80), ('feed', 'segment', 40), ('list', NULL, 70)),
  won AS (SELECT cells.*, coalesce(s.t, b.t) AS trust FROM cells LEFT JOIN trust s ON s.src = cells.src AND s.fld = cells.fld LEFT JOIN trust b ON b.src = cells.src AND b.fld IS NULL
    WHERE coalesce(s.t, b.t) IS NOT NULL AND v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, cells.fld ORDER BY coalesce(s.t, b.t) DESC, cells.src) = 1)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Customers as three sources and one without trust see them."""
    money = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    none = F.lit(None).cast("string")
    core = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("core").alias("source_system"), F.lit(1).cast("long").alias("version"), money("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    feed = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("feed").alias("source_system"), F.col("o_orderkey").alias("version"), money("o_totalprice").alias("balance"), F.col("o_orderpriority").alias("segment"))
    supplier = table(spark, d, "supplier")
    listed = supplier.select(F.col("s_suppkey").alias("k"), F.lit("list").alias("source_system"), F.lit(1).cast("long").alias("version"), money("s_acctbal").alias("balance"), none.alias("segment"))
    unknown = supplier.select(F.col("s_suppkey").alias("k"), F.lit("none").alias("source_system"), F.lit(1).cast("long").alias("version"), none.alias("balance"), F.col("s_name").alias("segment"))
    return core.unionByName(feed).unionByName(listed).unionByName(unknown)


def _blended(spark: SparkSession, d: str, pins: DataFrame | None = None) -> DataFrame:
    return canonical.blend(_sources(spark, d), trust_table(spark, _TRUST), "k", ["balance", "segment"], pins)


@register(f"WITH {_BLEND_SQL} SELECT k, max(CASE WHEN fld = 'balance' THEN v END) AS balance, max(CASE WHEN fld = 'segment' THEN v END) AS segment, count(*) AS fields_blended FROM won GROUP BY k")
def survivorship_blend(spark: SparkSession, d: str) -> DataFrame:
    return canonical.wide(_blended(spark, d), "k", ["balance", "segment"]).drop("provenance")


@register(f"WITH {_BLEND_SQL} SELECT fld AS field_name, src AS source_system, CAST(trust AS INTEGER) AS trust, count(*) AS n FROM won GROUP BY ALL")
def survivorship_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _n(_blended(spark, d), "field_name", "source_system", "trust")


@register(f"WITH {_BLEND_SQL} SELECT k, CASE WHEN k % 7 = 0 THEN NULL ELSE max(CASE WHEN fld = 'segment' THEN v END) END AS segment, k % 7 = 0 AS pinned FROM won WHERE fld = 'segment' GROUP BY k")
def pinned_override(spark: SparkSession, d: str) -> DataFrame:
    """A pin stands above all sources, even where it says null."""
    pins = table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("k"), F.lit("segment").alias("field_name"), F.lit(None).cast("string").alias("value"))
    return _blended(spark, d, pins).filter("field_name = 'segment'").select("k", F.col("value").alias("segment"), "pinned")


# --- exceptions, trust, chains -----------------------------------------------------------

_EXCEPTIONS_SQL = """exc AS (SELECT o_orderkey AS id, o_custkey AS k,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'RULE_' || (o_orderkey % 3) END AS rule_code, CASE WHEN o_orderkey % 6 = 0 THEN 'source_conflict' ELSE 'validation_failure' END AS exception_type,
    CASE o_orderkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'P' THEN 'rejected' ELSE 'open' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'interest_rate' WHEN 1 THEN 'loan_id' WHEN 2 THEN NULL ELSE 'property_state' END AS field_name FROM orders WHERE o_totalprice > 100000)"""


def _exceptions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda m, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (k % m + 1).cast("int"))
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").filter("o_totalprice > 100000").select(
        k.alias("id"),
        F.col("o_custkey").alias("k"),
        F.when(k % 6 != 0, F.concat(F.lit("RULE_"), (k % 3).cast("string"))).alias("rule_code"),
        F.lit(1).alias("rule_version"),
        F.when(k % 6 == 0, "source_conflict").otherwise("validation_failure").alias("exception_type"),
        pick(4, "LOW", "MEDIUM", "HIGH", "CRITICAL").alias("severity"),
        F.when(s == "F", "resolved").when(s == "P", "rejected").otherwise("open").alias("status"),
        pick(5, "interest_rate", "loan_id", None, "property_state", "property_state").alias("field_name"),
    )


@register(f"WITH {_EXCEPTIONS_SQL} SELECT CASE WHEN rule_code IS NULL THEN 'Source conflicts' ELSE rule_code || ' v1' END AS label, count(*) AS member_count FROM exc WHERE status = 'open' GROUP BY 1")
def cluster_assign(spark: SparkSession, d: str) -> DataFrame:
    return resolve.assign_clusters(_exceptions(spark, d))[1].select("label", "member_count")


@register(
    f"""WITH {_EXCEPTIONS_SQL} SELECT label, count(*) FILTER (status = 'open') AS open_count, count(*) AS total, count(DISTINCT k) AS loans,
      arg_max(severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS highest_severity
      FROM (SELECT *, CASE WHEN rule_code IS NULL THEN 'Source conflicts' ELSE rule_code || ' v1' END AS label FROM exc WHERE status = 'open') GROUP BY label"""
)
def cluster_list(spark: SparkSession, d: str) -> DataFrame:
    marked, found = resolve.assign_clusters(_exceptions(spark, d))
    return views.clusters(found, marked.withColumnRenamed("k", "loan_id")).drop("cluster_id", "severities")


@register(
    f"""WITH {_EXCEPTIONS_SQL} SELECT id, severity, CASE WHEN field_name IS NULL OR field_name <> 'property_state' THEN severity
      WHEN severity = 'CRITICAL' THEN 'HIGH' WHEN severity = 'HIGH' THEN 'MEDIUM' ELSE severity END AS suggested FROM exc"""
)
def severity_reclass(spark: SparkSession, d: str) -> DataFrame:
    return _exceptions(spark, d).select("id", "severity", assist.reclassified(F.col("severity"), F.col("field_name")).alias("suggested"))


@register(
    f"""WITH {_EXCEPTIONS_SQL} SELECT id, round(CAST(0.25 + CASE exception_type WHEN 'source_conflict' THEN 0.13 ELSE 0.07 END
      + CASE severity WHEN 'LOW' THEN 0.02 WHEN 'MEDIUM' THEN 0.03 WHEN 'HIGH' THEN 0.05 ELSE 0.07 END + CASE WHEN field_name = 'interest_rate' THEN 0.10 ELSE 0.04 END
      + CASE id % 3 WHEN 2 THEN 0.22 WHEN 1 THEN 0.11 ELSE 0.03 END + CASE WHEN field_name IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN id % 2 = 0 THEN 0.05 ELSE 0 END AS DOUBLE), 3) AS confidence FROM exc"""
)
def ai_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = _exceptions(spark, d)
    sure = assist.confidence(F.col("exception_type"), F.col("severity"), F.col("field_name"), F.col("id") % 3, F.col("field_name").isNotNull(), F.col("id") % 2 == 0)
    return e.select("id", sure.alias("confidence"))


@register(
    f"""WITH {_BLEND_SQL}, opts AS (SELECT c.k, c.fld, c.src, c.v, coalesce(s.t, b.t) AS trust, won.v AS now, c.k % 2 = 0 AS failed FROM cells c JOIN won ON won.k = c.k AND won.fld = c.fld
      LEFT JOIN trust s ON s.src = c.src AND s.fld = c.fld LEFT JOIN trust b ON b.src = c.src AND b.fld IS NULL WHERE c.v IS NOT NULL AND coalesce(s.t, b.t) IS NOT NULL)
      SELECT k || '/' || fld AS exception_id, v AS suggested_value, src AS suggested_source FROM opts WHERE NOT failed OR v <> now
      QUALIFY row_number() OVER (PARTITION BY k, fld ORDER BY CASE WHEN failed THEN 0 ELSE -trust END, src) = 1"""
)
def suggestion(spark: SparkSession, d: str) -> DataFrame:
    cells = canonical.trusted(canonical.candidates(_sources(spark, d), "k", ["balance", "segment"]), trust_table(spark, _TRUST))
    won = _blended(spark, d).select("k", "field_name", "value")
    kind = F.when(F.col("k") % 2 == 0, "validation_failure").otherwise("source_conflict")
    exceptions = won.select(F.concat_ws("/", F.col("k").cast("string"), "field_name").alias("exception_id"), kind.alias("exception_type"), "k", "field_name")
    return assist.suggestions(exceptions, cells, won, "k")


@register(
    f"""WITH {_EXCEPTIONS_SQL}, w AS (SELECT *, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 4 ELSE 8 END AS weight FROM exc),
      e AS (SELECT k, 100.0 * sum(CASE WHEN status <> 'open' THEN weight ELSE 0 END) / sum(weight) AS x FROM w GROUP BY k),
      r AS (SELECT o_custkey AS k, sum(CASE WHEN ok THEN weight ELSE 0 END) AS p, sum(CASE WHEN NOT ok THEN weight ELSE 0 END) AS q FROM (SELECT o_custkey, nullif(o_totalprice, 0) <= 120000 AS ok,
        CASE o_orderkey % 2 WHEN 0 THEN 2 ELSE 4 END AS weight FROM orders) GROUP BY 1),
      {_BLEND_SQL}, s AS (SELECT k, 100.0 * count(DISTINCT src) / 3 AS coverage, avg(trust) AS st FROM won GROUP BY k)
      SELECT c_custkey AS k, r.k IS NULL AS capped, CAST(round(least(CASE WHEN r.k IS NULL THEN 25 ELSE 100 END, 0.4 * coalesce(CASE WHEN p + q = 0 THEN 100 ELSE 100.0 * p / (p + q) END, 0) + 0.3 * coalesce(x, 100)
        + 0.15 * coalesce(coverage, 0) + 0.15 * coalesce(st, 0)) * 10) AS BIGINT) AS score_10 FROM customer LEFT JOIN e ON e.k = c_custkey LEFT JOIN r ON r.k = c_custkey LEFT JOIN s ON s.k = c_custkey"""
)
def trust_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("k", "capped", F.round(F.col("_raw") * 10).cast("long").alias("score_10"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "MEDIUM").otherwise("HIGH").alias("severity"), F.when(F.col("o_totalprice") <= 120000, "pass").otherwise("fail").alias("result")
    )
    entities = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    out = trust.trust_scores(entities, "k", results, _exceptions(spark, d), _blended(spark, d))
    raw = sum((F.col(c) * w for c, w in trust.FACTORS.items()), F.lit(0.0))
    return out.withColumn("_raw", F.when(F.col("capped"), F.least(raw, F.lit(25.0))).otherwise(raw))


@register("SELECT CASE WHEN s >= 90 THEN 'high' WHEN s >= 75 THEN 'good' WHEN s >= 50 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT c_acctbal / 100 AS s FROM customer) GROUP BY 1")
def trust_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _n(table(spark, d, "customer").select(trust.bucket(F.col("c_acctbal") / 100).alias("bucket")), "bucket")


@register(f"WITH {_EXCEPTIONS_SQL} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT k FROM exc WHERE status = 'open' AND severity IN ('HIGH', 'CRITICAL'))")
def eligibility_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return trust.eligible(rows, _exceptions(spark, d).withColumn("is_blocking", F.col("severity").isin("HIGH", "CRITICAL")), "k")


_LINKED_SQL = """SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE lag(h) OVER w END AS prev_hash, h AS hash, lag(h) OVER w AS before FROM
    (SELECT event_id, user_id, sha256('{"event_id":"' || event_id || '","event_type":"' || event_type || '","prev":null}') AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Events with digests of their own content, linked by the row before; every 97th link is cut."""
    from pyspark.sql import Window

    own = chain.digest(["event_id", "event_type"], F.lit(None).cast("string"), named="prev")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type").withColumn("hash", own)
    before = F.lag("hash").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("prev_hash", F.when(F.col("event_id") % 97 != 0, before))


@register(f"SELECT event_id, prev_hash IS NOT DISTINCT FROM before AS linked, hash FROM ({_LINKED_SQL})")
def hash_chain_links(spark: SparkSession, d: str) -> DataFrame:
    out = chain.checked(_linked(spark, d), ["user_id"], ["event_id"], ["event_id", "event_type"], named="prev")
    return out.select("event_id", (~F.col("problem").eqNullSafe("broken link")).alias("linked"), "hash")


@register(f"SELECT user_id, min(event_id) AS event_id FROM ({_LINKED_SQL}) WHERE prev_hash IS DISTINCT FROM before GROUP BY user_id")
def tamper_first_break(spark: SparkSession, d: str) -> DataFrame:
    out = chain.checked(_linked(spark, d), ["user_id"], ["event_id"], ["event_id", "event_type"], named="prev")
    return out.filter("problem = 'broken link'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


# --- joins, filters, aggregates -----------------------------------------------------------


@register("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 3 AND (c_name ILIKE '%0%' OR c_mktsegment ILIKE '%0%') ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20")
def filter_search_page(spark: SparkSession, d: str) -> DataFrame:
    rows = views.searched(views.filtered(table(spark, d, "customer"), c_nationkey=3), ["c_name", "c_mktsegment"], "0")
    return views.page(rows.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_custkey"], 2, 20)


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    picked = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(picked, "c_custkey", "left_semi")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 250000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    picked = table(spark, d, "orders").filter("o_custkey is not null and o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(picked, "c_custkey", "left_anti")


_LOANS_SQL = """WITH exc AS (SELECT o_custkey AS loan_id, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
  ver AS (SELECT o_custkey AS loan_id, max(o_totalprice) AS best, arg_max(o_totalprice, o_orderkey) AS latest FROM orders GROUP BY 1)"""


@register(
    f"""{_LOANS_SQL} SELECT c_custkey AS loan_id, coalesce(exc.n, 0) AS open_exceptions, latest AS trust_score FROM customer LEFT JOIN exc ON exc.loan_id = c_custkey
      JOIN ver ON ver.loan_id = c_custkey WHERE best BETWEEN 100000 AND 300000 AND c_mktsegment = 'BUILDING'"""
)
def loan_browser(spark: SparkSession, d: str) -> DataFrame:
    """Trust range over a loan's best version, its latest trust, and its open exceptions."""
    orders = table(spark, d, "orders").withColumn("loan_id", F.col("o_custkey"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("loan_id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("borrower_id"))
    exceptions = orders.select("loan_id", F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))
    verified = orders.select("loan_id", F.col("o_totalprice").alias("trust_score"), F.col("o_orderkey").alias("version"))
    records = orders.select("loan_id", F.col("o_orderpriority").alias("source_system"))
    out = views.loans(rows, exceptions, verified, records, status="BUILDING", trust_min=100000, trust_max=300000)
    return out.select("loan_id", "open_exceptions", "trust_score")


@register("SELECT n_name, count(c_custkey) AS customers, coalesce(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS in_debt FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' GROUP BY n_name")
def left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))
    joined = table(spark, d, "nation").join(part, "n_nationkey", "left")
    return joined.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("in_debt", F.lit(0)).alias("in_debt"))


@register(
    """SELECT r_name, c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY ALL"""
)
def three_way_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).select("o_custkey")
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name")
    who = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    joined = orders.join(who, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))


@register(
    "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o, max(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey"
)
def pivot_max(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_totalprice"))
    return out.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


_MATCH_SQL = """a AS (SELECT l_returnflag AS rule_code, l_suppkey % 50 AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
  b AS (SELECT l_returnflag AS rule_code, l_suppkey % 50 AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_quantity < 30 GROUP BY ALL)"""


def _two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("rule_code"), (F.col("l_suppkey") % 50).alias("k"), "l_linestatus", "l_quantity")
    return rows.filter("l_linestatus = 'O'").select("rule_code", "k"), rows.filter("l_linestatus = 'F' and l_quantity < 30").select("rule_code", "k")


@register(
    f"WITH {_MATCH_SQL} SELECT rule_code, coalesce(sum(a.n), 0)::BIGINT AS oracle, coalesce(sum(b.n), 0)::BIGINT AS engine, coalesce(sum(least(a.n, b.n)) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL), 0)::BIGINT AS matched FROM a FULL JOIN b USING (rule_code, k) GROUP BY rule_code"
)
def multiset_match(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.matched(*_two_sides(spark, d), ["rule_code", "k"], "rule_code").select("rule_code", "oracle", "engine", "matched")


@register(
    f"""WITH {_MATCH_SQL}, t AS (SELECT rule_code, coalesce(sum(a.n), 0)::BIGINT AS oracle, coalesce(sum(b.n), 0)::BIGINT AS engine, coalesce(sum(least(a.n, b.n)) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL), 0)::BIGINT AS m
        FROM a FULL JOIN b USING (rule_code, k) GROUP BY rule_code), u AS (SELECT rule_code, oracle, engine, CASE WHEN rule_code = 'R' THEN least(oracle, engine) ELSE m END AS matched FROM t)
      SELECT rule_code, oracle, engine, matched, engine - matched AS extra, oracle - matched AS missed,
        CASE WHEN engine > matched AND oracle > matched THEN 'both' WHEN engine > matched THEN 'extra' WHEN oracle > matched THEN 'missed' ELSE 'ok' END AS status FROM u"""
)
def reconcile_buckets(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconciled(*_two_sides(spark, d), ["rule_code", "k"], "rule_code", by_count="^R$")


@register(
    """SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE 'total' END AS dimension, coalesce(o_orderstatus, o_orderpriority) AS value, count(*) AS n
      FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"""
)
def stats_marginals(spark: SparkSession, d: str) -> DataFrame:
    return views.marginals(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS discounted, count(*) FILTER (l_tax = 0) AS untaxed, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def count_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@register("SELECT o_custkey, list_aggregate(list_sort(list_distinct(list(o_orderpriority))), 'string_agg', ',') AS priorities FROM orders GROUP BY 1")
def array_agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@register("SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1 HAVING max(o_totalprice) BETWEEN 200000 AND 300000")
def having_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best")).filter("best between 200000 and 300000")


@register(
    """SELECT user_id, sum(n)::BIGINT AS n, arg_min(event_type, (-n, event_type)) AS top_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"""
)
def mode_summary(spark: SparkSession, d: str) -> DataFrame:
    """The commonest event type of each user, ties by name."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("loan_id"), F.lit("x").alias("field_name"), F.col("event_type").alias("exception_type"), F.lit("LOW").alias("severity"))
    return assist.cluster_summaries(rows).select(F.col("cluster_id").alias("user_id"), F.col("n_members").alias("n"), F.col("top_exception_type").alias("top_type"))


@register(
    """SELECT 'event' AS kind, event_id AS ref, epoch_us(ts) AS at_us FROM events WHERE user_id = 7 UNION ALL SELECT 'order', o_orderkey, epoch_us(o_orderdate) FROM orders WHERE o_custkey = 7"""
)
def timeline_union(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").filter("user_id = 7").select(F.col("event_id").alias("ref"), "ts")
    orders = table(spark, d, "orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("ref"), "o_orderdate")
    return views.timeline(("event", events, "ts"), ("order", orders, "o_orderdate")).select("kind", "ref", F.unix_micros("at").alias("at_us"))


@register(
    """SELECT 'oracle' AS missing_from, p_partkey AS code FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
      UNION ALL SELECT DISTINCT 'rules', l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part)"""
)
def distinct_diff(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "part").select(F.col("p_partkey").alias("code"))
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("code"))
    return reconcile.contract_gaps(have, used, "code")


@register("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return _n(table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k")), "event_type", "k")


@register("SELECT user_id AS loan_id, event_id AS version, value AS trust_score FROM events WHERE value >= 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def export_latest_flat(spark: SparkSession, d: str) -> DataFrame:
    """The latest of the versions that reach a trust, flattened for a file."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("loan_id"), F.col("event_id").alias("version"), F.col("value").alias("trust_score"), F.struct(F.col("value").alias("trust_score"), F.col("user_id").alias("loan_id")).alias("data"))
    entities = rows.select("loan_id", F.lit("b").alias("borrower_id"), F.lit("verified").alias("status")).distinct()
    return tapes.flat_for_json(views.export(rows, entities, min_trust=50), ["loan_id", "version", "trust_score"], "data")


@register("SELECT CAST(100 * p // t AS INTEGER) AS progress, count(*) AS n FROM (SELECT o_custkey, count(*) AS t, count(*) FILTER (o_orderstatus <> 'O') AS p FROM orders GROUP BY 1) GROUP BY 1")
def file_progress(spark: SparkSession, d: str) -> DataFrame:
    """Counters and progress by file, with customers as files and open orders as failed rows."""
    raw = table(spark, d, "orders").select(F.col("o_custkey").alias("raw_file_id"), F.when(F.col("o_orderstatus") == "O", "x").alias("parse_error"))
    done = tapes.counters(raw).withColumn("progress", tapes.progress(F.col("parsed_count"), F.col("row_count"), F.lit("processing")))
    return _n(done, "progress")


@register(
    f"""WITH {_EXCEPTIONS_SQL} SELECT CASE WHEN status <> 'open' THEN status WHEN id % 4 = 0 THEN 'rejected' WHEN id % 4 IN (1, 2) THEN 'resolved' ELSE 'open' END AS status, count(*) AS n FROM exc GROUP BY 1"""
)
def decisions_applied(spark: SparkSession, d: str) -> DataFrame:
    """Accepting decisions resolve, rejects reject, decided exceptions stay as they are."""
    e = _exceptions(spark, d).withColumn("exception_id", F.col("id"))
    k = F.col("id") % 4
    decisions = e.filter(k != 3).select("exception_id", F.when(k == 0, "reject").when(k == 1, "accept").otherwise("manual_resolution").alias("action"), F.col("id").alias("decision_id"), F.lit(1).alias("decided_at"))
    return _n(resolve.decided(e, decisions), "status")


@register(
    f"""WITH {_EXCEPTIONS_SQL} SELECT id, status FROM exc WHERE status <> 'open' OR k % 2 = 0 OR (rule_code, k) NOT IN (SELECT (rule_code, k) FROM exc WHERE status <> 'open' AND rule_code IS NOT NULL) OR rule_code IS NULL"""
)
def rerun_keeps_decisions(spark: SparkSession, d: str) -> DataFrame:
    """A forced run makes open exceptions anew, except where a decision for rule and record stands."""
    e = _exceptions(spark, d).select("id", "rule_code", "k", "status")
    fresh = e.filter("status = 'open'")
    even, odd = fresh.filter("k % 2 = 0"), fresh.filter("k % 2 = 1")
    return validate.rerun(e.filter("status <> 'open'"), odd, ["rule_code", "k"]).unionByName(even).select("id", "status")

