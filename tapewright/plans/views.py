"""Read queries over the engine's tables: browsers, details, timelines, dashboards, exports.

Every function returns a DataFrame; pages are cut by ``page`` with a unique tie-breaker, so
Spark plans a top-n instead of a full sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.canonical import newest_versions
from ..operators.resolve import severity_rank
from ..operators.trust import bucket

PER_PAGE, MOST = 50, 200
SHOWN_ROWS = 200


def page(df: DataFrame, order: list[Column | str], number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """Rows of one page: numbers from 1, at most MOST rows."""
    size = max(1, min(MOST, per_page))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def paged(df: DataFrame, order: list[Column | str], number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """A page with ``total_rows`` and ``total_pages`` of all that was filtered; counted apart, so the page stays a top-n."""
    total = df.count()
    return page(df, order, number, per_page).withColumns({"total_rows": F.lit(total).cast("long"), "total_pages": F.lit(page_count(total, per_page)).cast("long")})


def page_count(total: int, per_page: int = PER_PAGE) -> int:
    size = max(1, min(MOST, per_page))
    return -(-total // size)


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters for the values that are given."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def searched(df: DataFrame, columns: list[str], text: str | None) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case; % and _ are wildcards."""
    if not text:
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns]))


def loans(
    loans_: DataFrame, exceptions: DataFrame, verified: DataFrame, records: DataFrame, *, status: str | None = None, borrower: str | None = None, search: str | None = None,
    trust_min: float | None = None, trust_max: float | None = None, open_exceptions: bool | None = None, source: str | None = None,
) -> DataFrame:
    """The loan browser: filters, then open exceptions, latest trust and sources of each loan.

    The trust range looks at a loan's best version, the column shows its latest one.
    """
    out = searched(filtered(loans_, status=status, borrower_id=borrower), ["loan_id", "borrower_id"], search)
    if trust_min is not None or trust_max is not None:
        best = verified.groupBy("loan_id").agg(F.max("trust_score").alias("_t"))
        fits = F.lit(True) if trust_min is None else F.col("_t") >= trust_min
        best = best.filter(fits if trust_max is None else fits & (F.col("_t") <= trust_max))
        out = out.join(best, "loan_id", "left_semi")
    waiting = exceptions.filter("status = 'open' and loan_id is not null")
    if open_exceptions is not None:
        out = out.join(waiting.select("loan_id"), "loan_id", "left_semi" if open_exceptions else "left_anti")
    if source is not None:
        out = out.join(records.filter(F.col("source_system") == source).select("loan_id"), "loan_id", "left_semi")
    n_open = waiting.groupBy("loan_id").agg(F.count(F.lit(1)).alias("open_exceptions"))
    latest_trust = verified.groupBy("loan_id").agg(F.max_by("trust_score", "version").alias("trust_score"))
    sources = records.groupBy("loan_id").agg(F.array_sort(F.collect_set("source_system")).alias("sources"))
    joined = out.join(n_open, "loan_id", "left").join(latest_trust, "loan_id", "left").join(sources, "loan_id", "left")
    return joined.withColumn("open_exceptions", F.coalesce("open_exceptions", F.lit(0)))


def details(records: DataFrame, exceptions: DataFrame, results: DataFrame, verified: DataFrame) -> dict[str, DataFrame]:
    """Of every loan: the latest record of each source, exceptions by kind, verdict counts and versions."""
    n = lambda s: F.count_if(F.col("result") == s).alias(s)
    return {
        "records": newest_versions(records, ["loan_id", "source_system"], "version"),
        "exceptions": exceptions.groupBy("loan_id", "exception_type", "severity", "status").agg(F.count(F.lit(1)).alias("n")),
        "validation": results.groupBy("loan_id").agg(n("pass"), n("fail"), n("not_applicable")),
        "verified": verified,
    }


def loan_detail(loan_id: str, records: DataFrame, exceptions: DataFrame, results: DataFrame, verified: DataFrame) -> dict[str, DataFrame]:
    """``details`` of one loan, its versions newest first."""
    mine = {name: df.filter(F.col("loan_id") == loan_id) for name, df in details(records, exceptions, results, verified).items()}
    return mine | {"verified": mine["verified"].orderBy(F.desc("version"))}


def timelines(key: str, *streams: tuple[str, DataFrame, str]) -> DataFrame:
    """``timeline`` of every entity at once, with the ``place`` of each event in its entity's own."""
    parts = [df.withColumn("kind", F.lit(kind)).withColumn("kind_order", F.lit(i)).withColumn("at", F.col(at)).select(key, "kind", "kind_order", "ref", "at") for i, (kind, df, at) in enumerate(streams)]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at", "kind_order", "ref")))


def by_source(records: DataFrame, key: str, value: str, sources: list[str]) -> DataFrame:
    """One row per entity with each source's largest value in a column of the source's name, from one pass."""
    return records.groupBy(key).agg(*(F.max(F.when(F.col("source_system") == s, F.col(value))).alias(s) for s in sources))


def timeline(*streams: tuple[str, DataFrame, str]) -> DataFrame:
    """One stream of events in time order: (kind, rows, time column) each; ties by kind and ``ref``."""
    parts = [df.withColumn("kind", F.lit(kind)).withColumn("kind_order", F.lit(i)).withColumn("at", F.col(at)) for i, (kind, df, at) in enumerate(streams)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.orderBy("at", "kind_order", *(["ref"] if "ref" in both.columns else []))


def marginals(df: DataFrame, columns: list[str], flag: str | None = None) -> DataFrame:
    """Counts by each column alone and in all, from one pass: (dimension, value, n).

    A null value is told from a rolled-up one by the grouping's id.
    """
    which = reduce(lambda acc, ic: acc.when(F.grouping(ic) == 0, ic), columns[1:], F.when(F.grouping(columns[0]) == 0, columns[0])).otherwise("total")
    value = F.coalesce(*(F.col(c).cast("string") for c in columns))
    grouped = df.groupingSets([[c] for c in columns] + [[]], *columns)
    return grouped.agg(which.alias("dimension"), F.count(F.lit(1)).alias("n"), *([F.count_if(F.col(flag)).alias(f"n_{flag}")] if flag else [])).select("dimension", value.alias("value"), "n", *([f"n_{flag}"] if flag else []))


def exception_stats(exceptions: DataFrame) -> DataFrame:
    return marginals(exceptions, ["status", "severity", "exception_type"])


def dashboard(loans_: DataFrame, exceptions: DataFrame, verified: DataFrame, records: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The summary's parts; trust figures are over all verified versions."""
    one = F.count(F.lit(1)).alias("n")
    return {
        "loans_by_status": loans_.groupBy("status").agg(one),
        "exceptions": exception_stats(exceptions),
        "loans_with_open": exceptions.filter("status = 'open'").agg(F.count_distinct("loan_id").alias("n")),
        "verified": verified.agg(one, F.count_distinct("loan_id").alias("loans"), F.avg("trust_score").alias("mean_trust")),
        "trust_histogram": verified.groupBy(bucket(F.col("trust_score")).alias("bucket")).agg(one),
        "source_coverage": records.groupBy("source_system").agg(F.count_distinct("loan_id").alias("loans")),
        "results": results.groupBy("result").agg(one),
    }


def export(verified: DataFrame, loans_: DataFrame, min_trust: float | None = None, status: str | None = None) -> DataFrame:
    """The latest version of each loan among those that reach ``min_trust``: an older one may be the latest that does."""
    good = verified if min_trust is None else verified.filter(F.col("trust_score") >= min_trust)
    return newest_versions(good, ["loan_id"], "version").join(filtered(loans_, status=status).select("loan_id", "borrower_id", "status"), "loan_id")


def exceptions_list(
    exceptions: DataFrame, loans_: DataFrame | None = None, *, status: str | None = None, severity: str | None = None, exception_type: str | None = None,
    loan_id: str | None = None, cluster_id: str | None = None, blocking_only: bool = False, search: str | None = None,
) -> DataFrame:
    """The review queue, most severe first.  Searching needs a loan, so quarantined rows don't show up there."""
    out = filtered(exceptions, status=status, severity=severity, exception_type=exception_type, loan_id=loan_id, cluster_id=cluster_id)
    out = out.filter("is_blocking") if blocking_only else out
    if search and loans_ is not None:
        out = searched(out.join(loans_.select("loan_id", "borrower_id"), "loan_id"), ["loan_id", "borrower_id"], search)
    return out.orderBy(severity_rank(F.col("severity")).desc(), "exception_id")


def enriched(exceptions: DataFrame, loans_: DataFrame, rules: DataFrame, users: DataFrame) -> DataFrame:
    """A page of exceptions with the borrower's id, the rule's explanation and the assignee's name; none of them need exist."""
    out = exceptions.join(loans_.select("loan_id", "borrower_id"), "loan_id", "left")
    out = out.join(rules.select("rule_code", "explanation"), "rule_code", "left")
    return out.join(users.select(F.col("user_id").alias("assigned_to"), F.col("name").alias("assignee")), "assigned_to", "left")


def exception_details(exceptions: DataFrame, results: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Every exception with the newest verdict of its rule on its loan, and how many recommendations it has."""
    judged = newest_versions(results, ["loan_id", "rule_code"], "evaluated_at").select("loan_id", "rule_code", F.struct(*(c for c in results.columns if c not in ("loan_id", "rule_code"))).alias("result"))
    n = recommendations.groupBy("exception_id").agg(F.count(F.lit(1)).alias("recommendations"))
    return exceptions.join(judged, ["loan_id", "rule_code"], "left").join(n, "exception_id", "left").withColumn("recommendations", F.coalesce("recommendations", F.lit(0).cast("long")))


def exception_detail(exception_id: str, exceptions: DataFrame, results: DataFrame, recommendations: DataFrame) -> dict[str, DataFrame]:
    """One exception as ``exception_details`` shows it, and its recommendations."""
    one = exceptions.filter(F.col("exception_id") == exception_id)
    judged = results.join(one.select("loan_id", "rule_code"), ["loan_id", "rule_code"], "left_semi")
    mine = recommendations.filter(F.col("exception_id") == exception_id)
    return {"exception": exception_details(one, judged, mine), "recommendations": mine}


def clusters(clusters_: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Clusters with open members, loans and the highest severity, fullest first; empty ones stay."""
    members = exceptions.filter("cluster_id is not null")
    worst = F.max_by("severity", severity_rank(F.col("severity"))).alias("highest_severity")
    sums = members.groupBy("cluster_id").agg(F.count_if(F.col("status") == "open").alias("open_count"), F.count(F.lit(1)).alias("total"), F.count_distinct("loan_id").alias("loans"), worst)
    by = members.groupBy("cluster_id", "severity").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("severities"))
    out = clusters_.select("cluster_id", "label").join(sums, "cluster_id", "left").join(by, "cluster_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("open_count", "total", "loans")]
    return out.select("cluster_id", "label", *zero, "highest_severity", "severities").orderBy(F.desc("open_count"), "label")


def verified_list(verified: DataFrame, min_trust: float | None = None, latest_only: bool = False) -> DataFrame:
    out = verified if min_trust is None else verified.filter(F.col("trust_score") >= min_trust)
    return newest_versions(out, ["loan_id"], "version") if latest_only else out


def audit_events(events: DataFrame, *, event_type: str | None = None, entity_type: str | None = None, actor_type: str | None = None, loan_key: str | None = None, from_seq: object = None, to_seq: object = None) -> DataFrame:
    """Audit events in order; bounds that are no integers are ignored."""
    out = filtered(events, event_type=event_type, entity_type=entity_type, actor_type=actor_type, loan_key=loan_key)
    for bound, keep in ((from_seq, lambda n: F.col("seq") >= n), (to_seq, lambda n: F.col("seq") <= n)):
        text = str(bound).strip() if bound is not None else ""
        if text.lstrip("+-").isdigit():
            out = out.filter(keep(int(text)))
    return out.orderBy(F.desc("seq") if loan_key is not None else F.asc("seq"))


def audit_stats(events: DataFrame) -> dict[str, DataFrame]:
    n = F.count(F.lit(1)).alias("n")
    return {
        "by_type": events.groupBy("event_type").agg(n).orderBy(F.desc("n"), "event_type"),
        "by_actor": events.groupBy("actor_type").agg(n).orderBy(F.desc("n"), "actor_type"),
        "latest": events.agg(F.count(F.lit(1)).alias("events"), F.max_by("event_type", "seq").alias("last_type"), F.max("created_at").alias("last_at")),
    }


def files_list(files: DataFrame) -> DataFrame:
    from ..sources.tapes import progress

    return files.withColumn("progress", progress(F.col("parsed_count"), F.col("row_count"), F.col("status"))).orderBy(F.desc("uploaded_at"), "raw_file_id")


def file_detail(raw_file_id: str, raw: DataFrame, exceptions: DataFrame) -> dict[str, DataFrame]:
    """A file's first failed and quarantined rows, SHOWN_ROWS of each."""
    mine = raw.filter(F.col("raw_file_id") == raw_file_id)
    held = exceptions.filter("exception_type = 'import_error'").select("raw_record_id", "severity")
    return {
        "failed": mine.filter("parse_error is not null").orderBy("row_number").limit(SHOWN_ROWS),
        "quarantined": mine.join(held, "raw_record_id").orderBy("row_number").limit(SHOWN_ROWS),
    }
