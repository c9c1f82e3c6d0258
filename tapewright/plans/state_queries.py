"""Queries over standing tables: batches of edits, minted versions, clusters, chains and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import FIELD_TYPES, Rule, trust_table
from ..operators import canonical, chain, edits, minting, resolve, trust, validate
from ..operators.conditions import all_of, fields
from ..sources import landing_table
from ..sources.landing_table import LandingTable, Upload
from ..sources.shared import new_path, written
from ..sources.tables import table
from ..sources.tapes import ERRORS, SPARK_TYPES
from . import runs
from .ledger import Ledger
from .queries import _BLEND_SQL, _EXCEPTIONS_SQL, _TRUST, CLOCK, _exceptions, _scores, _sources, register
from .view_queries import _CHAIN, _CHAIN_SQL, _chained

f = fields()
_FIELDS = {"balance": "current_balance", "segment": "property_type"}


def exact_round(x: str, places: int = 2) -> str:
    """SQL that rounds a double as its shortest decimal text says, halves away from zero."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {places}) AS DOUBLE)"


def _score_sql(results: str, exceptions: str, winners: str, entities: str) -> str:
    """Scores by SQL from results(k, weight, result), exceptions(k, weight, status) and winners(k, src, trust), with sums in one order."""
    return f"""sc_e AS (SELECT k, sum(CASE WHEN status IN ('resolved', 'rejected') THEN weight ELSE 0 END) * CAST(100 AS DOUBLE) / sum(weight) AS x FROM {exceptions} GROUP BY k),
      sc_r AS (SELECT k, sum(CASE WHEN result = 'pass' THEN weight ELSE 0 END) AS p, sum(CASE WHEN result = 'fail' THEN weight ELSE 0 END) AS q FROM {results} GROUP BY k),
      sc_s AS (SELECT k, count(DISTINCT CASE WHEN src <> 'human_override' THEN src END) * CAST(100 AS DOUBLE) / 3 AS coverage, avg(trust) AS st FROM {winners} GROUP BY k),
      sc_f AS (SELECT e.k, sc_r.k IS NULL AS capped, coalesce(CASE WHEN p + q = 0 THEN CAST(100 AS DOUBLE) ELSE p * CAST(100 AS DOUBLE) / (p + q) END, CAST(0 AS DOUBLE)) AS f1,
        coalesce(x, CAST(100 AS DOUBLE)) AS f2, least(coalesce(coverage, CAST(0 AS DOUBLE)), CAST(100 AS DOUBLE)) AS f3, coalesce(st, CAST(0 AS DOUBLE)) AS f4
        FROM {entities} e LEFT JOIN sc_e ON sc_e.k = e.k LEFT JOIN sc_r ON sc_r.k = e.k LEFT JOIN sc_s ON sc_s.k = e.k),
      sc AS (SELECT *, f1 * CAST(0.4 AS DOUBLE) + f2 * CAST(0.3 AS DOUBLE) + f3 * CAST(0.15 AS DOUBLE) + f4 * CAST(0.15 AS DOUBLE) AS raw FROM sc_f),
      scored AS (SELECT *, {exact_round("greatest(least(CASE WHEN capped THEN least(raw, CAST(25 AS DOUBLE)) ELSE raw END, CAST(100 AS DOUBLE)), CAST(0 AS DOUBLE))")} AS trust_score FROM sc)"""


_WEIGHT = "CASE {0} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 4 ELSE 8 END"
_RESULTS_SQL = "res AS (SELECT o_custkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 2 ELSE 4 END AS weight, CASE WHEN o_totalprice <= 120000 THEN 'pass' ELSE 'fail' END AS result FROM orders)"


@register(
    f"""WITH {_EXCEPTIONS_SQL}, ex AS (SELECT k, status, {_WEIGHT.format("severity")} AS weight FROM exc), {_RESULTS_SQL}, {_BLEND_SQL}, {_score_sql("res", "ex", "won", "(SELECT c_custkey AS k FROM customer)")}
      SELECT k, trust_score FROM scored"""
)
def trust_score_column(spark: SparkSession, d: str) -> DataFrame:
    """The weighted sum of the four factors, capped without evidence, clamped and rounded."""
    return _scores(spark, d).select("k", "trust_score")


# --- edits ---------------------------------------------------------------------------------


def _as_records(rows: DataFrame) -> DataFrame:
    """Rows with loan_id, source_system, version and some canonical fields as records of an import."""
    data = F.struct(*((F.col(c) if c in rows.columns else F.lit(None)).cast("string" if c == "loan_id" else SPARK_TYPES[t]).alias(c) for c, t in FIELD_TYPES.items()))
    given = [c for c in FIELD_TYPES if c in rows.columns]
    return rows.select(
        "loan_id", F.concat_ws("/", F.col("loan_id").cast("string"), "source_system", F.col("version").cast("string")).alias("raw_record_id"), "source_system", "version", data.alias("data"),
        F.create_map().cast(ERRORS).alias("field_errors"), F.array(*map(F.lit, given)).alias("in_scope"), F.lit("import").alias("origin"), F.lit(None).cast("long").alias("effective_at"),
    )


def _standing(spark: SparkSession, d: str) -> edits.Standing:
    rows = _sources(spark, d).withColumnsRenamed(_FIELDS | {"k": "loan_id"})
    policy = trust_table(spark, [(s, _FIELDS.get(name, name), t) for s, name, t in _TRUST])
    winners = canonical.blend(rows, policy, "loan_id", list(_FIELDS.values()))
    k = F.col("o_orderkey")
    results = table(spark, d, "orders").select(
        F.col("o_custkey").alias("loan_id"), k.cast("string").alias("raw_record_id"), F.lit("IMPORTED").alias("rule_code"), F.lit(1).alias("rule_version"), F.when(k % 2 == 0, "MEDIUM").otherwise("HIGH").alias("severity"),
        F.when(F.col("o_totalprice") <= 120000, "pass").otherwise("fail").alias("result"),
    )
    exceptions = _exceptions(spark, d).select(
        F.col("id").cast("string").alias("exception_id"), F.col("k").alias("loan_id"), "exception_type", "rule_code", "rule_version", "field_name", "severity", F.col("severity").isin("HIGH", "CRITICAL").alias("is_blocking"), "status", F.lit(None).cast("string").alias("decision_id")
    )
    records, winners, results, exceptions = (written(x, "standing") for x in (_as_records(rows), winners, results, exceptions))
    scores = trust.trust_scores(winners.select("loan_id").distinct(), "loan_id", results, exceptions, winners)
    return edits.Standing(records, winners, results, exceptions, written(scores, "standing"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every third exception is decided: edited, accepted, rejected, or resolved by hand with a field given twice."""
    k = F.col("o_orderkey")
    change = lambda name, value: F.struct(F.lit(name).alias("field_name"), value.alias("value"))
    money = (F.col("o_totalprice").cast("decimal(12,2)") - 200000).cast("string")
    by_hand = F.array(change("property_type", F.col("o_orderpriority")), change("property_type", F.concat(F.lit("P"), (k % 5).cast("string"))))
    return table(spark, d, "orders").filter(k % 3 == 0).select(
        F.concat(F.lit("d"), k.cast("string")).alias("decision_id"), k.cast("string").alias("exception_id"), k.alias("decided_at"),
        F.when(k % 12 == 0, "edit").when(k % 12 == 3, "accept").when(k % 12 == 6, "reject").otherwise("manual_resolution").alias("action"),
        F.when(k % 12 == 0, F.array(change("current_balance", money))).when(k % 12 == 9, by_hand).alias("changes"),
    )


_EDIT_RULES = [Rule("BALANCE", "HIGH", "balance {current_balance} is below zero", f.current_balance >= 0)]


def _applied(spark: SparkSession, d: str) -> tuple[edits.Standing, edits.Applied]:
    state = _standing(spark, d)
    return state, edits.apply(state, _decisions(spark, d), _EDIT_RULES, CLOCK)


_EDITS_SQL = f"""{_EXCEPTIONS_SQL}, {_BLEND_SQL},
  done AS (SELECT exc.id, exc.k, o_totalprice - 200000 AS balance, CAST(CAST(o_totalprice AS DECIMAL(12,2)) - 200000 AS VARCHAR) AS balance_text, 'P' || (id % 5) AS kind, CASE id % 12 WHEN 0 THEN 'edit' WHEN 3 THEN 'accept' WHEN 6 THEN 'reject' ELSE 'manual_resolution' END AS action
    FROM exc JOIN orders ON o_orderkey = exc.id WHERE exc.status = 'open' AND id % 3 = 0),
  changes AS (SELECT id, k, action, 'current_balance' AS fld, balance_text AS v FROM done WHERE action = 'edit' UNION ALL SELECT id, k, action, 'property_type', kind FROM done WHERE action = 'manual_resolution'),
  pins AS (SELECT k, fld, arg_max(v, id) AS v FROM changes GROUP BY k, fld),
  old AS (SELECT k, CASE fld WHEN 'balance' THEN 'current_balance' ELSE 'property_type' END AS fld, v, src, trust FROM won),
  cell AS (SELECT k, fld, v, src, trust, false AS pinned FROM old WHERE (k, fld) NOT IN (SELECT (k, fld) FROM pins) UNION ALL SELECT k, fld, v, 'human_override', 100, true FROM pins)"""


@register(f"WITH {_EDITS_SQL} SELECT k AS loan_id, fld AS field_name, v AS value, src AS source_system, pinned FROM cell")
def edits_blended(spark: SparkSession, d: str) -> DataFrame:
    """Canonical cells after a batch of decisions, as a blend of all records and pins would give them."""
    state, done = _applied(spark, d)
    return edits.merged(state, done.changed).winners.select("loan_id", "field_name", "value", "source_system", "pinned")


@register(
    f"""WITH {_EDITS_SQL}, {_RESULTS_SQL},
      res2 AS (SELECT * FROM res UNION ALL SELECT k, 4, CASE WHEN action <> 'edit' THEN 'not_applicable' WHEN balance >= 0 THEN 'pass' ELSE 'fail' END FROM done WHERE action IN ('edit', 'manual_resolution')),
      ex2 AS (SELECT exc.k, {_WEIGHT.format("severity")} AS weight, CASE WHEN done.id IS NULL THEN status WHEN action = 'reject' THEN 'rejected' ELSE 'resolved' END AS status FROM exc LEFT JOIN done ON done.id = exc.id
        UNION ALL SELECT k, 4, 'open' FROM done WHERE action = 'edit' AND balance < 0),
      {_score_sql("res2", "ex2", "cell", "(SELECT DISTINCT k FROM cell)")}
      SELECT k AS loan_id, trust_score FROM scored"""
)
def edits_rescored(spark: SparkSession, d: str) -> DataFrame:
    """Scores after a batch of decisions, as a full run would give them."""
    state, done = _applied(spark, d)
    return edits.merged(state, done.changed).scores.select("loan_id", "trust_score")


@register(
    f"""WITH {_EDITS_SQL}, told AS (SELECT id, c.k, c.fld, c.v, coalesce(lag(c.v) OVER (PARTITION BY c.k, c.fld ORDER BY id), old.v) AS before FROM changes c LEFT JOIN old ON old.k = c.k AND old.fld = c.fld)
      SELECT 'd' || id AS decision_id, 'field_edited' AS event_type, '{{"' || fld || '":' || coalesce('"' || before || '"', 'null') || '}}' AS before_value, '{{"' || fld || '":"' || v || '"}}' AS after_value FROM told
      UNION ALL SELECT 'd' || id, CASE WHEN action IN ('edit', 'accept') THEN 'loan_approved' ELSE 'loan_rejected' END, NULL, '{{"action":"' || action || '","old_status":"open","new_status":"' ||
        CASE action WHEN 'reject' THEN 'rejected' ELSE 'resolved' END || '","changes_count":' || CASE action WHEN 'edit' THEN 1 WHEN 'manual_resolution' THEN 2 ELSE 0 END || '}}' FROM done"""
)
def edits_audited(spark: SparkSession, d: str) -> DataFrame:
    """What each decision says to the audit log, with the values that stood before."""
    return _applied(spark, d)[1].audit.select("decision_id", "event_type", "before_value", "after_value")


@register(f"WITH {_EXCEPTIONS_SQL} SELECT 'd' || o_orderkey AS decision_id, CASE WHEN exc.id IS NULL THEN 'unknown exception' ELSE 'already decided' END AS reason FROM orders LEFT JOIN exc ON exc.id = o_orderkey WHERE o_orderkey % 3 = 0 AND (exc.id IS NULL OR status <> 'open')")
def edits_refused(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d)[1].refused.select("decision_id", "reason")


# --- versions --------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The file behind each source, once for each record that came from it."""
    s = F.col("source_system")
    return _sources(spark, d).select(F.col("k").alias("loan_id"), F.concat(F.lit("file-"), s).alias("file_id"), F.concat(s, F.lit(".csv")).alias("filename"), s.alias("file_kind"), s, F.sha2(s, 256).alias("file_hash"))


def _summaries(spark: SparkSession, d: str, state: edits.Standing) -> DataFrame:
    return minting.summaries(state.results, state.exceptions, _files(spark, d))


_FILES_SQL = """src AS (SELECT c_custkey AS k, 'core' AS s FROM customer UNION SELECT o_custkey, 'feed' FROM orders UNION SELECT s_suppkey, 'list' FROM supplier UNION SELECT s_suppkey, 'none' FROM supplier),
  files AS (SELECT k, '[' || string_agg('{"file_hash":"' || sha256(s) || '","file_id":"file-' || s || '","file_kind":"' || s || '","filename":"' || s || '.csv","source_system":"' || s || '"}', ',' ORDER BY s) || ']' AS files FROM src GROUP BY k)"""


def _summary_sql(results: str, exceptions: str) -> str:
    """k, validation and exception counts and their JSON by SQL from results(k, result) and exceptions(k, exception_type, severity, status)."""
    n = "count(*) FILTER (result = '{0}')"
    return f"""su_r AS (SELECT k, count(*) AS rt, {n.format("pass")} AS rp, {n.format("fail")} AS rf, {n.format("not_applicable")} AS rn FROM {results} GROUP BY k),
      su_t AS (SELECT k, '{{' || string_agg('"' || exception_type || '":' || n, ',' ORDER BY exception_type) || '}}' AS by_type FROM (SELECT k, exception_type, count(*) AS n FROM {exceptions} GROUP BY ALL) GROUP BY k),
      su_e AS (SELECT k, count(*) AS et, count(*) FILTER (status IN ('resolved', 'rejected')) AS er, count(*) FILTER (status = 'open' AND severity IN ('HIGH', 'CRITICAL')) AS eb FROM {exceptions} GROUP BY k),
      su AS (SELECT k, coalesce(rt, 0) AS rt, coalesce(rp, 0) AS rp, coalesce(rf, 0) AS rf, coalesce(rn, 0) AS rn, coalesce(et, 0) AS et, coalesce(er, 0) AS er, coalesce(eb, 0) AS eb, coalesce(by_type, '{{}}') AS by_type, coalesce(files, '[]') AS files
        FROM (SELECT DISTINCT k FROM cell) LEFT JOIN su_r USING (k) LEFT JOIN su_t USING (k) LEFT JOIN su_e USING (k) LEFT JOIN files USING (k))"""


@register(
    f"""WITH {_EXCEPTIONS_SQL}, {_RESULTS_SQL}, {_FILES_SQL}, cell AS (SELECT DISTINCT k FROM src), {_summary_sql("res", "exc")},
      sev AS (SELECT k, count(*) FILTER (weight = 4 AND result = 'fail') AS high_failed FROM res GROUP BY k)
      SELECT k AS loan_id, rt AS total, rp AS passed, rf AS failed, coalesce(high_failed, 0) AS high_failed, et AS exceptions, er AS resolved, eb AS blocking_open, by_type, files FROM su LEFT JOIN sev USING (k)"""
)
def loan_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts, exceptions and files of every loan in one pass."""
    out = _summaries(spark, d, _standing(spark, d))
    high = F.coalesce(F.try_element_at("by_severity", F.lit("HIGH"))["fail"], F.lit(0).cast("long"))
    return out.select(
        "loan_id", F.col("validation.total").alias("total"), F.col("validation.pass").alias("passed"), F.col("validation.fail").alias("failed"), high.alias("high_failed"), F.col("exceptions.total").alias("exceptions"), F.col("exceptions.resolved").alias("resolved"),
        F.col("exceptions.blocking_open").alias("blocking_open"), F.to_json("exceptions.by_type").alias("by_type"), F.to_json(F.transform("source_files", lambda x: F.struct(x["file_hash"], x["file_id"], x["file_kind"], x["filename"], x["source_system"]))).alias("files"),
    )


def _snap_sql(step: int, results: str, exceptions: str, cells: str) -> str:
    """Contents of loans at one step: ``cells`` (k, fld, v, src, trust, version, pinned), each CTE with the step in its name."""
    told = """'"' || fld || '":{"pinned":' || pinned || ',"source_system":"' || src || '","trust_score":' || trust || coalesce(',"version":' || version, '') || '}'"""
    inner = f"""cell AS (SELECT * FROM {cells}), {_score_sql(results, exceptions, "cell", "(SELECT DISTINCT k FROM cell)")}, {_summary_sql(results, exceptions)},
      doc AS (SELECT k, '{{' || string_agg('"' || fld || '":' || coalesce('"' || v || '"', 'null'), ',' ORDER BY fld) || '}}' AS data, '{{' || string_agg({told}, ',' ORDER BY fld) || '}}' AS told,
        '[' || coalesce(string_agg(DISTINCT CASE WHEN src <> 'human_override' THEN '"' || src || '"' END, ',' ORDER BY CASE WHEN src <> 'human_override' THEN '"' || src || '"' END), '') || ']' AS sources FROM cell GROUP BY k)"""
    two = lambda x: f"CAST({exact_round(x)} AS VARCHAR)"
    return f"""snap{step} AS (WITH {inner} SELECT k, eb, trust_score, data, told, files,
      '{{"exceptions":{{"blocking_open":' || eb || ',"by_type":' || by_type || ',"total":' || et || '}},"validation":{{"fail":' || rf || ',"not_applicable":' || rn || ',"pass":' || rp || ',"total":' || rt || '}}}}' AS summary,
      '{{"exception_counts":{{"open":' || (et - er) || ',"resolved":' || er || ',"total":' || et || '}},"exception_health":' || {two("f2")} || ',"has_validation_evidence":' || (NOT capped) || ',"no_evidence_cap":' || CASE WHEN capped AND raw > 25 THEN '25.0' ELSE 'null' END ||
        ',"severity_weights":{{"CRITICAL":8,"HIGH":4,"LOW":1,"MEDIUM":2}},"source_coverage":' || {two("f3")} || ',"source_trust_average":' || {two("f4")} || ',"sources":' || sources || ',"validation_counts":{{"fail":' || rf || ',"not_applicable":' || rn || ',"pass":' || rp ||
        '}},"validation_pass_rate":' || {two("f1")} || ',"weights":{{"exception_health":0.3,"source_coverage":0.15,"source_trust_average":0.15,"validation_pass_rate":0.4}}}}' AS breakdown
      FROM scored JOIN doc USING (k) JOIN su USING (k)),
      content{step} AS (SELECT *, sha256(data || chr(10) || told || chr(10) || files || chr(10) || CAST(trust_score AS VARCHAR) || chr(10) || summary) AS content FROM snap{step} WHERE eb = 0)"""


def _record_sql(step: int, rows: str) -> str:
    """Digests of rows (k, version, prev and a content)."""
    return f"""minted{step} AS (SELECT *, sha256('{{"canonical_data":' || data || ',"field_provenance":' || told || ',"id":"' || sha256(k || '|' || version || '|' || content) || '","loan_id":"' || k || '","prev_record_hash":' || coalesce('"' || prev || '"', 'null') ||
      ',"source_files":' || files || ',"trust_score":' || CAST(trust_score AS VARCHAR) || ',"trust_score_breakdown":' || breakdown || ',"validation_summary":' || summary || ',"verified_at":"1998-08-0{step + 3}","verified_by":"reviewer","version":' || version || '}}') AS hash FROM ({rows}))"""


_MINT_SQL = f"""{_EDITS_SQL}, {_RESULTS_SQL}, {_FILES_SQL},
  versions AS (SELECT c_custkey AS k, 'core' AS src, 1 AS version FROM customer UNION ALL SELECT s_suppkey, 'list', 1 FROM supplier UNION ALL SELECT o_custkey, 'feed', max(o_orderkey) FROM orders GROUP BY 1),
  cell0 AS (SELECT old.*, version, false AS pinned FROM old JOIN versions USING (k, src)), cell1 AS (SELECT cell.k, fld, v, src, trust, version, pinned FROM cell LEFT JOIN versions USING (k, src)),
  ex0 AS (SELECT *, {_WEIGHT.format("severity")} AS weight FROM exc),
  ex1 AS (SELECT exc.k, exc.exception_type, severity, {_WEIGHT.format("severity")} AS weight, CASE WHEN done.id IS NULL THEN status WHEN action = 'reject' THEN 'rejected' ELSE 'resolved' END AS status FROM exc LEFT JOIN done ON done.id = exc.id
    UNION ALL SELECT k, 'validation_failure', 'HIGH', 4, 'open' FROM done WHERE action = 'edit' AND balance < 0),
  res1 AS (SELECT * FROM res UNION ALL SELECT k, 4, CASE WHEN action <> 'edit' THEN 'not_applicable' WHEN balance >= 0 THEN 'pass' ELSE 'fail' END FROM done WHERE action IN ('edit', 'manual_resolution')),
  {_snap_sql(0, "res", "ex0", "cell0")}, {_snap_sql(1, "res1", "ex1", "cell1")},
  {_record_sql(0, "SELECT *, 1 AS version, NULL AS prev FROM content0")},
  {_record_sql(1, "SELECT c.*, coalesce(m.version, 0) + 1 AS version, m.hash AS prev FROM content1 c LEFT JOIN minted0 m USING (k) WHERE m.k IS NULL OR m.content <> c.content")}"""


def _minted(spark: SparkSession, d: str) -> DataFrame:
    """A version before a batch of decisions and one after it."""
    state, done = _applied(spark, d)
    snaps = minting.snapshots(state.winners, state.scores, _summaries(spark, d, state))
    first = written(minting.minted(snaps, state.exceptions, None, None, "reviewer", "1998-08-03")[0], "versions")
    later = edits.merged(state, done.changed)
    later.winners, later.exceptions = written(later.winners, "later"), written(later.exceptions, "later")  # each is read more than once
    decided = _decisions(spark, d).join(later.exceptions.filter("decision_id is not null").select("loan_id", "decision_id"), "decision_id")
    again = minting.snapshots(later.winners, later.scores, _summaries(spark, d, later))
    return first.unionByName(minting.minted(again, later.exceptions, first, decided, "reviewer", "1998-08-04")[0])


@register(
    f"""WITH {_MINT_SQL}, every AS (SELECT k, version, hash, prev, 0 AS step FROM minted0 UNION ALL SELECT k, version, hash, prev, 1 FROM minted1), said AS (SELECT k, string_agg('d' || id, ',' ORDER BY id) AS ids FROM done GROUP BY k)
      SELECT every.k AS loan_id, CAST(version AS INTEGER) AS version, hash AS record_hash, prev AS prev_record_hash, CASE WHEN step = 1 THEN ids END AS decisions FROM every LEFT JOIN said ON said.k = every.k"""
)
def minted_versions(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of all loans that nothing blocks, before and after edits: the second only where the content changed."""
    return _minted(spark, d).select("loan_id", "version", "record_hash", "prev_record_hash", F.array_join("decision_ids", ",").alias("decisions"))


# --- standing tables --------------------------------------------------------------------------


@register(
    f"""WITH {_BLEND_SQL}, old AS (SELECT c_custkey AS k, 'balance' AS fld, CASE WHEN c_custkey % 11 = 0 THEN '1.00' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS v, c_custkey % 11 = 0 AS pinned, 'core' AS src FROM customer
        UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END, c_custkey % 7 = 0, 'core' FROM customer),
      new AS (SELECT k, fld, v, src, k % 77 = 0 AND fld = 'segment' AS pinned FROM won WHERE k % 3 <> 0),
      merged AS (SELECT coalesce(new.k, old.k) AS k, coalesce(new.fld, old.fld) AS fld, CASE WHEN new.pinned THEN 'again' WHEN old.pinned THEN old.v ELSE coalesce(new.v, old.v) END AS v,
        coalesce(new.pinned, false) OR coalesce(old.pinned, false) AS pinned, coalesce(new.src, old.src) AS src FROM new FULL JOIN old ON old.k = new.k AND old.fld = new.fld)
      SELECT k, fld AS field_name, v AS value, CASE WHEN pinned THEN 'human_override' ELSE src END AS source_system, pinned FROM merged"""
)
def canonical_upserts(spark: SparkSession, d: str) -> DataFrame:
    """New blends over standing rows, pins among them; a third of the entities has no new records."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    pin = lambda rows, name, value: rows.select("k", F.lit(name).alias("field_name"), F.lit(value).cast("string").alias("value"))
    pins = pin(customers.filter("k % 7 = 0"), "segment", None).unionByName(pin(customers.filter("k % 11 = 0"), "balance", "1.00"))
    sources, policy = _sources(spark, d), trust_table(spark, _TRUST)
    before = canonical.blend(sources.filter("source_system = 'core'"), policy, "k", list(_FIELDS), pins)
    now = canonical.blend(sources.filter("k % 3 <> 0"), policy, "k", list(_FIELDS), pin(customers.filter("k % 77 = 0 and k % 3 <> 0"), "segment", "again"))
    out = canonical.upserted(canonical.as_maps(before, "k"), canonical.as_maps(now, "k"), "k")
    cells = out.select("k", F.explode("data").alias("field_name", "value"), "provenance")
    return cells.select("k", "field_name", "value", F.try_element_at("provenance", F.col("field_name"))["source_system"].alias("source_system"), F.try_element_at("provenance", F.col("field_name"))["pinned"].alias("pinned"))


@register(
    f"""WITH {_EXCEPTIONS_SQL}, named AS (SELECT CASE WHEN rule_code IS NULL THEN 'Source conflicts' ELSE rule_code || ' v1' END AS label, status, id FROM exc),
      first AS (SELECT label, count(*) FILTER (status = 'open') AS before FROM named WHERE status = 'open' GROUP BY label)
      SELECT first.label, before, count(id) FILTER (status = 'open' AND NOT (id % 4 = 1 OR first.label = 'RULE_2 v1')) AS after FROM first JOIN named USING (label) GROUP BY ALL
      UNION ALL SELECT 'LATE v2', 0, count(*) FROM orders WHERE o_orderkey % 1000 = 1"""
)
def clusters_carried(spark: SparkSession, d: str) -> DataFrame:
    """Standing counts moved by a batch of decisions and new exceptions; a cluster that lost all members stays with 0."""
    marked, before = resolve.assign_clusters(_exceptions(spark, d))
    gone = marked.filter("status = 'open' and (id % 4 = 1 or rule_code = 'RULE_2')").withColumn("old_status", F.col("status")).withColumn("old_cluster_id", F.col("cluster_id")).withColumn("status", F.lit("resolved"))
    late = table(spark, d, "orders").filter("o_orderkey % 1000 = 1").select(F.col("o_orderkey").alias("id"), F.lit("LATE").alias("rule_code"), F.lit(2).alias("rule_version"), F.lit("validation_failure").alias("exception_type"), F.lit("open").alias("status"))
    after = resolve.regrouped(before, gone.unionByName(late, allowMissingColumns=True))
    return after.select("label", F.col("member_count").alias("after")).join(before.select("label", F.col("member_count").alias("before")), "label", "left").select("label", F.coalesce("before", F.lit(0).cast("long")).alias("before"), "after")


# --- files and runs -----------------------------------------------------------------------------

_STAGES = ("land", "records", "validate", "exceptions", "blend", "score")
#: Which stages work: the first run, its repetition, after decisions, forced.
_WORK = {1: _STAGES, 2: (), 3: ("score",), 4: _STAGES[1:]}
_TAPE_RULES = [Rule("PRINCIPAL", "CRITICAL", "principal {original_principal}", f.original_principal >= 0), Rule("BALANCE_CAP", "HIGH", "balance {current_balance}", f.current_balance <= 300000)]


def _uploads(spark: SparkSession, d: str, folder: str) -> list[Upload]:
    """Customers and their largest orders as CSV files of two kinds."""
    loan = lambda c: F.concat(F.lit("LN-"), F.col(c).cast("string")).alias("loan_id")
    money = lambda c: c.cast("decimal(12,2)").cast("string")
    tape = table(spark, d, "customer").select(loan("c_custkey"), F.col("c_nationkey").cast("string").alias("borrower_id"), money(F.col("c_acctbal")).alias("original_principal"))
    feed = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most")).select(loan("o_custkey"), money(F.col("most")).alias("current_balance"))
    out = []
    for kind, rows in (("loan_tape", tape), ("servicer_update", feed)):
        path = f"{folder}/{kind}"
        rows.write.option("header", True).csv(path)
        out += [Upload(f"{path}/{name}.csv", kind) for name in landing_table.names_in(spark, path, ".csv")]
    return out


@register(
    " UNION ALL ".join(f"SELECT CAST({run} AS BIGINT) AS run, '{stage}' AS what, CAST({int(stage in work)} AS BIGINT) AS n" for run, work in _WORK.items() for stage in _STAGES)
    + """ UNION ALL SELECT run, status, n FROM (WITH bad AS (SELECT c_custkey % 5 = 0 AS fifth FROM customer WHERE CAST(c_acctbal AS DECIMAL(12,2)) < 0),
        cap AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING CAST(max(o_totalprice) AS DECIMAL(12,2)) > 300000)
      SELECT run, 'open' AS status, (SELECT count(*) FROM cap) + (SELECT count(*) FROM bad WHERE run < 3 OR NOT fifth) AS n FROM range(1, 5) r(run) UNION ALL SELECT run, 'resolved', (SELECT count(*) FROM bad WHERE fifth) FROM range(3, 5) r(run))
      UNION ALL SELECT CAST(1 AS BIGINT), 'rows', (SELECT count(*) FROM customer) + (SELECT count(DISTINCT o_custkey) FROM orders)"""
)
def ledger_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run over files, its repetition, a run after decisions and a forced one: which stages worked, and exceptions by status."""
    folder = new_path(spark, "runs")
    uploads = _uploads(spark, d, f"{folder}/files")
    policy = [("OriginationCore", None, 60), ("ServicerFeed", None, 80)]
    said, counts = [], None
    for run in _WORK:
        if run == 3:
            found = Ledger(spark, folder).latest("exceptions")["exceptions"].filter("rule_code = 'PRINCIPAL' and cast(substring(loan_id, 4) as long) % 5 = 0")
            decisions = found.select(F.concat(F.lit("d-"), "loan_id").alias("decision_id"), "exception_id", F.lit("accept").alias("action"), F.lit(1).alias("decided_at"))
            runs.decided(spark, folder, decisions, _TAPE_RULES, CLOCK)
        tables, log = runs.verify_folder(spark, folder, uploads, _TAPE_RULES, policy, CLOCK, force=run == 4)
        said += [(run, stage, int(worked)) for stage, worked in log]
        one = tables["exceptions"].groupBy(F.col("status").alias("what")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(run).cast("long").alias("run"), "what", "n")
        counts = one if counts is None else counts.unionByName(one)
    landed = LandingTable(spark, f"{folder}/raw").manifest().agg(F.sum("row_count").alias("n")).select(F.lit(1).cast("long").alias("run"), F.lit("rows").alias("what"), "n")
    return spark.createDataFrame(said, "run long, what string, n long").unionByName(counts).unionByName(landed)


# --- verdicts in detail, chains on growing logs ---------------------------------------------------


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records: every second source declares no status, every fifth principal is malformed, some are blank."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("loan_id"), F.lit("core").alias("source_system"), F.lit(1).alias("version"), F.when((k % 5 != 0) & (k % 7 != 0), F.col("o_totalprice")).alias("original_principal"),
        (F.col("o_totalprice") / 2).alias("current_balance"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("payment_status"), k.alias("_k"),
    )
    records = _as_records(rows)
    n = F.col("loan_id")
    wrong = F.create_map(F.lit("original_principal"), F.struct(F.concat(F.lit("x"), n.cast("string")).alias("raw"), F.lit("float").alias("expected")))
    scope = F.when(n % 2 == 0, F.array(*map(F.lit, ("loan_id", "original_principal", "current_balance", "payment_status")))).otherwise(F.array(*map(F.lit, ("loan_id", "original_principal", "current_balance"))))
    return records.withColumn("field_errors", F.when(n % 5 == 0, wrong.cast(ERRORS)).otherwise(F.create_map().cast(ERRORS))).withColumn("in_scope", scope)


_SCOPED_SQL = """s AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS bad, o_orderkey % 2 = 0 AS declared, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS p, o_totalprice / 2 AS b, o_orderstatus AS st FROM orders),
  judged AS (SELECT *, p > 100000 AS v1, CASE WHEN declared THEN st <> 'F' END AS v2 FROM s)"""


@register(
    f"""WITH {_SCOPED_SQL} SELECT k AS loan_id, CASE WHEN v1 = false THEN 'fail' WHEN v2 = false THEN 'fail' WHEN v1 AND v2 THEN 'pass' ELSE 'not_applicable' END AS result,
      CASE WHEN v1 = false THEN 'original_principal' ELSE 'original_principal,payment_status' END AS touched, CASE WHEN bad THEN 'original_principal=x' || k || '/float' ELSE '' END AS field_errors,
      CASE WHEN (v1 IS NULL OR v1) AND NOT declared THEN 'payment_status' ELSE '' END AS out_of_scope FROM judged"""
)
def rule_details(spark: SparkSession, d: str) -> DataFrame:
    """What led to a verdict on records with gaps: fields that the source doesn't supply, and cells that couldn't be read."""
    rules = [Rule("R", "HIGH", "", all_of(f.original_principal > 100000, f.payment_status.differs("F")))]
    out = validate.validate_records(_scoped(spark, d), rules, CLOCK, tells=validate.DETAILS)
    errors = F.array_join(F.transform(F.map_entries("field_errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["raw"], F.lit("/"), e["value"]["expected"])), ",")
    return out.select(F.col("loan_id").cast("long").alias("loan_id"), "result", F.array_join("touched", ",").alias("touched"), errors.alias("field_errors"), F.array_join("out_of_scope", ",").alias("out_of_scope"))


@register(
    f"""{_CHAIN_SQL}, seen AS (SELECT user_id, count(*) AS seen, max(event_id) AS till FROM c WHERE event_id <= 6000 GROUP BY user_id), bad AS (SELECT user_id, event_id FROM c WHERE event_id % 89 = 0)
      SELECT 'since' AS part, user_id, min(event_id) AS event_id, 0 AS seen FROM bad WHERE event_id > coalesce((SELECT till FROM seen WHERE seen.user_id = bad.user_id), 0) GROUP BY user_id
      UNION ALL SELECT 'full', user_id, min(event_id), 0 FROM bad GROUP BY user_id UNION ALL SELECT 'mark', user_id, till, seen FROM seen"""
)
def chains_since_marks(spark: SparkSession, d: str) -> DataFrame:
    """Logs that grew after a check: what came since is checked alone, and forgery before the mark is left to the full check."""
    whole = written(_chained(spark, d), "chain", "zstd")  # linked once, checked three times
    before = whole.filter("event_id <= 6000")
    good = chain.checked(before, *_CHAIN, nested=("after_value",)).filter("problem is not null")
    marks = written(chain.marked(before, ["user_id"], "event_id", problems=good), "marks")
    forged = whole.withColumn("event_type", F.when(F.col("event_id") % 89 == 0, "forged").otherwise(F.col("event_type")))
    none = F.lit(0).cast("long").alias("seen")
    since = chain.first_break(forged, *_CHAIN, nested=("after_value",), marks=marks).select(F.lit("since").alias("part"), "user_id", "event_id", none)
    full = chain.first_break(forged, *_CHAIN, nested=("after_value",)).select(F.lit("full").alias("part"), "user_id", "event_id", none)
    return since.unionByName(full).unionByName(marks.select(F.lit("mark").alias("part"), "user_id", F.col("at").alias("event_id"), "seen"))


@register(f"{_CHAIN_SQL} SELECT 'audit' AS chain, false AS ok, count(*) AS problems FROM c WHERE event_id % 89 = 0 UNION ALL SELECT 'records', true, 0")
def chains_reported(spark: SparkSession, d: str) -> DataFrame:
    """Audit and record chains in one result: the one forged, the other whole."""
    audit = written(_chained(spark, d), "chain", "zstd").withColumn("event_type", F.when(F.col("event_id") % 89 == 0, "forged").otherwise(F.col("event_type")))
    records = chain.appended(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    records = written(records, "chain", "zstd")
    whole = chain.checked(records, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"]).select("o_custkey", "o_orderkey", "problem")
    return chain.report(audit=chain.checked(audit, *_CHAIN, nested=("after_value",)).select("user_id", "event_id", "problem"), records=whole).select("chain", "ok", "problems")
