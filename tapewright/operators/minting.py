"""Verified versions: a loan's snapshot with summary, files and score, linked by hash to the version before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chain, trust

#: What a version's digest covers, and the parts of it that hold JSON.
RECORD_FIELDS = ("id", "loan_id", "version", "canonical_data", "field_provenance", "validation_summary", "source_files", "trust_score", "trust_score_breakdown", "verified_by", "verified_at")
RECORD_JSON = ("canonical_data", "field_provenance", "validation_summary", "source_files", "trust_score", "trust_score_breakdown", "version")
PREV = "prev_record_hash"
#: Names of the factors in a breakdown.
FACTOR_NAMES = {"validation": "validation_pass_rate", "exceptions": "exception_health", "coverage": "source_coverage", "source_trust": "source_trust_average"}
VERDICTS = ("pass", "fail", "not_applicable")
NULLS = {"ignoreNullFields": "false"}


def summaries(results: DataFrame, exceptions: DataFrame, files: DataFrame) -> DataFrame:
    """One row a loan: verdicts in all and by severity, exceptions in all and by type, and the files behind it.

    ``results``: loan_id, severity, result.  ``exceptions``: loan_id, exception_type, severity,
    status; those without a loan are left out.  ``files``: loan_id and the columns of a file, file_id among
    them, repeated as often as records have it.  All three are counted in one pass:
    equal rows are summed up before they move, and a loan's few counts meet once.
    """
    about = [c for c in files.columns if c != "loan_id"]
    none = F.lit(None).cast("string")
    nofile = F.lit(None).cast(files.select(F.struct(*about)).schema[0].dataType)
    rows = (
        results.select("loan_id", F.lit("result").alias("part"), F.col("severity").alias("a"), F.col("result").alias("b"), none.alias("c"), nofile.alias("file"))
        .unionAll(exceptions.select("loan_id", F.lit("exception"), F.col("exception_type"), F.col("status"), F.col("severity"), nofile))
        .unionAll(files.select("loan_id", F.lit("file"), none, none, none, F.struct(*about)))
        .filter("loan_id is not null")
    )
    counted = rows.groupBy("loan_id", "part", "a", "b", "c", "file").agg(F.count(F.lit(1)).alias("n"))
    one = counted.groupBy("loan_id").agg(F.collect_list(F.struct("part", "a", "b", "c", "file", "n")).alias("all"))
    part = lambda name: F.filter("all", lambda x: x["part"] == name)
    one = one.select("loan_id", part("result").alias("r"), part("exception").alias("e"), F.array_sort(F.transform(part("file"), lambda x: x["file"])).alias("source_files"))
    total = lambda items, test: F.aggregate(F.filter(items, test), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    every = lambda x: F.lit(True)
    by = lambda items, value: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(items, lambda x: x["a"]))), lambda name: F.struct(name.alias("key"), value(name).alias("value"))))
    verdict = lambda v, name=None: total(F.col("r"), lambda x: (x["b"] == v) & (F.lit(True) if name is None else x["a"] == name))
    done = lambda x: x["b"].isin("resolved", "rejected")
    return one.select(
        "loan_id",
        F.struct(total(F.col("r"), every).alias("total"), *(verdict(v).alias(v) for v in VERDICTS)).alias("validation"),
        by(F.col("r"), lambda name: F.struct(*(verdict(v, name).alias(v) for v in VERDICTS))).alias("by_severity"),
        F.struct(
            total(F.col("e"), every).alias("total"), total(F.col("e"), done).alias("resolved"), total(F.col("e"), lambda x: ~done(x)).alias("open"),
            total(F.col("e"), lambda x: (x["b"] == "open") & x["c"].isin("HIGH", "CRITICAL")).alias("blocking_open"), by(F.col("e"), lambda name: total(F.col("e"), lambda x: x["a"] == name)).alias("by_type"),
        ).alias("exceptions"),
        "source_files",
    )


def summary_json() -> Column:
    """A summary as it is stored and hashed."""
    return F.to_json(F.struct("validation", F.struct("exceptions.total", "exceptions.by_type", "exceptions.blocking_open").alias("exceptions")))


def breakdown_json(sources: Column) -> Column:
    """A score's factors, weights, counts and sources, of rows with the columns of a score and a summary.

    ``sources``: names of the sources that won a field.  The cap is named only where it lowered the score.
    """
    raw = sum((F.col(f"score.{c}") * w for c, w in trust.FACTORS.items()), F.lit(0.0))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return F.to_json(
        F.struct(
            *(F.round(f"score.{c}", 2).alias(name) for c, name in FACTOR_NAMES.items()),
            F.struct(*(F.lit(trust.FACTORS[c]).alias(name) for c, name in FACTOR_NAMES.items())).alias("weights"),
            F.struct(*(F.lit(w).alias(s) for s, w in trust.SEVERITY_WEIGHT.items())).alias("severity_weights"),
            F.struct(*(count(F.col(f"summary.validation.{v}")).alias(v) for v in VERDICTS)).alias("validation_counts"),
            F.struct(*(count(F.col(f"summary.exceptions.{v}")).alias(v) for v in ("total", "resolved", "open"))).alias("exception_counts"),
            F.array_sort(sources).alias("sources"),
            (~F.col("score.capped")).alias("has_validation_evidence"),
            F.when(F.col("score.capped") & (raw > trust.UNPROVEN), trust.UNPROVEN).alias("no_evidence_cap"),
        ),
        NULLS,
    )


def snapshots(winners: DataFrame, scores: DataFrame, summary: DataFrame) -> DataFrame:
    """One row a loan with a canonical row: the five parts of its content as canonical JSON, breakdown, and ``content_hash``.

    Files and fields stand in a fixed order, so the digest doesn't depend on the order they came in.
    """
    told = F.struct("source_system", F.col("trust").alias("trust_score"), *(c for c in ("record_id", "version") if c in winners.columns), "pinned")
    entry = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("field_name").alias("key"), value.alias("value")))))
    machine = F.collect_set(F.when(F.col("source_system") != trust.HUMAN, F.col("source_system")))
    rows = winners.groupBy("loan_id").agg(entry(F.col("value")).alias("data"), entry(told).alias("told"), machine.alias("sources"))
    both = rows.join(scores.select("loan_id", F.struct(*(c for c in scores.columns if c != "loan_id")).alias("score")), "loan_id")
    both = both.join(summary.select("loan_id", F.struct(*(c for c in summary.columns if c != "loan_id")).alias("summary")), "loan_id", "left")
    no_counts = F.struct(*(F.lit(0).cast("long").alias(v) for v in ("total", *VERDICTS)))
    nothing = F.struct(F.lit(0).cast("long").alias("total"), F.create_map().cast("map<string,bigint>").alias("by_type"), F.lit(0).cast("long").alias("blocking_open"))
    exceptions = F.when(F.col("summary").isNull(), nothing).otherwise(F.struct("summary.exceptions.total", "summary.exceptions.by_type", "summary.exceptions.blocking_open"))
    parts = {
        "canonical_data": F.to_json("data", NULLS),
        "field_provenance": F.to_json("told"),
        "validation_summary": F.to_json(F.struct(F.when(F.col("summary").isNull(), no_counts).otherwise(F.col("summary.validation")).alias("validation"), exceptions.alias("exceptions"))),
        "source_files": F.coalesce(F.to_json("summary.source_files"), F.lit("[]")),
        "trust_score_breakdown": breakdown_json(F.col("sources")),
    }
    out = both.select("loan_id", F.col("score.trust_score").alias("trust_score"), *(chain.canonical_text(x).alias(c) for c, x in parts.items()))
    content = ("canonical_data", "field_provenance", "source_files", "trust_score", "validation_summary")
    return out.withColumn("content_hash", F.sha2(F.concat_ws("\n", *(F.col(c).cast("string") for c in content)), 256))


def blocked(exceptions: DataFrame) -> DataFrame:
    """Loans with open blocking exceptions, and why they can't be verified."""
    bad = exceptions.filter("status = 'open' and is_blocking and loan_id is not null").groupBy("loan_id").agg(F.count(F.lit(1)).alias("n"))
    return bad.select("loan_id", F.concat(F.col("n").cast("string"), F.lit(" open blocking exception(s)")).alias("reason"))


def minted(snaps: DataFrame, exceptions: DataFrame, verified: DataFrame | None, decisions: DataFrame | None, by: str, at: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new versions, loans that were refused with the reason).

    A loan gets a version if nothing open blocks it and its content differs from that of
    its latest one; so a repeated run mints nothing.  ``verified``: earlier versions as returned here.
    ``decisions``: loan_id, decision_id, decided_at.  ``asked`` (loan_id): the loans to verify,
    all by default; one without a canonical row is refused.
    """
    stop = blocked(exceptions)
    if asked is not None:
        snaps = snaps.join(asked, "loan_id", "left_semi")
        missing = asked.join(snaps.select("loan_id"), "loan_id", "left_anti").join(stop.select("loan_id"), "loan_id", "left_anti")
        refused = stop.join(asked, "loan_id", "left_semi").unionByName(missing.select("loan_id", F.lit("no canonical record").alias("reason")))
    else:
        refused = stop.join(snaps.select("loan_id"), "loan_id", "left_semi")
    ready = trust.new_versions(snaps.join(stop.select("loan_id"), "loan_id", "left_anti"), verified, "loan_id")
    if decisions is None:
        ready = ready.withColumn("decision_ids", F.lit(None).cast("array<string>"))
    else:
        listed = decisions.groupBy("loan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("decided_at", "decision_id"))), lambda x: x["decision_id"]).alias("decision_ids"))
        ready = ready.join(listed, "loan_id", "left")
    named = ready.withColumn("id", F.sha2(F.concat_ws("|", F.col("loan_id").cast("string"), F.col("version").cast("string"), "content_hash"), 256)).withColumn("verified_by", F.lit(by)).withColumn("verified_at", F.lit(at))
    texts = named.withColumn("_score", F.col("trust_score")).withColumn("trust_score", F.col("trust_score").cast("string")).withColumn("version", F.col("version").cast("string"))
    hashed = texts.withColumn("record_hash", chain.digest(list(RECORD_FIELDS), F.col(PREV), RECORD_JSON, PREV))
    columns = [c for c in RECORD_FIELDS if c not in ("trust_score", "version")]
    return hashed.select(*columns, F.col("version").cast("int").alias("version"), F.col("_score").alias("trust_score"), "content_hash", "decision_ids", PREV, "record_hash"), refused


def checked(verified: DataFrame) -> DataFrame:
    """Versions with ``problem``: each loan's chain on its own, digests recomputed."""
    texts = verified.withColumn("_n", F.col("version")).withColumn("version", F.col("version").cast("string")).withColumn("_score", F.col("trust_score")).withColumn("trust_score", F.col("trust_score").cast("string"))
    out = chain.checked(texts, ["loan_id"], ["_n"], list(RECORD_FIELDS), PREV, "record_hash", RECORD_JSON, PREV)
    return out.withColumn("version", F.col("_n")).withColumn("trust_score", F.col("_score")).select(*verified.columns, "problem")
