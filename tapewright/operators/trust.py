"""Trust scores, eligibility, verified versions and their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import FILE_SOURCES, HUMAN

#: Weights of the four factors, of severities, and the cap without evidence.
FACTORS = {"validation": 0.40, "exceptions": 0.30, "coverage": 0.15, "source_trust": 0.15}
SEVERITY_WEIGHT = {"LOW": 1, "MEDIUM": 2, "HIGH": 4, "CRITICAL": 8}
UNPROVEN = 25.0
BUCKETS = ((90, "high"), (75, "good"), (50, "fair"))
N_SOURCES = len(FILE_SOURCES)


def severity_weight(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv)), severity), F.lit(1))


def validation_factor(results: DataFrame, key: str) -> DataFrame:
    """Severity-weighted share of passes, in per cent; 100 if no rule applies to any record."""
    w = severity_weight(F.col("severity"))
    passed, failed = (F.sum(F.when(F.col("result") == s, w).otherwise(0)) for s in ("pass", "fail"))
    sums = results.groupBy(key).agg(passed.alias("w_pass"), failed.alias("w_fail"), F.count(F.lit(1)).alias("n_results"))
    score = F.when(F.col("w_pass") + F.col("w_fail") == 0, 100.0).otherwise(F.col("w_pass") * 100.0 / (F.col("w_pass") + F.col("w_fail")))
    return sums.withColumn("validation", score)


def exception_factor(exceptions: DataFrame, key: str) -> DataFrame:
    """Severity-weighted share of decided exceptions, in per cent."""
    w = severity_weight(F.col("severity"))
    done = F.sum(F.when(F.col("status").isin("resolved", "rejected"), w).otherwise(0))
    return exceptions.groupBy(key).agg((done * 100.0 / F.sum(w)).alias("exceptions"), F.count(F.lit(1)).alias("n_exceptions"))


def source_factors(winners: DataFrame, key: str, sources: int = N_SOURCES) -> DataFrame:
    """Share of sources that won a field (people aside), and mean trust over fields (pins count 100)."""
    machine = F.count_distinct(F.when(F.col("source_system") != HUMAN, F.col("source_system")))
    return winners.groupBy(key).agg((machine * 100.0 / sources).alias("coverage"), F.avg("trust").alias("source_trust"), F.count(F.lit(1)).alias("n_fields"))


def trust_scores(entities: DataFrame, key: str, results: DataFrame, exceptions: DataFrame, winners: DataFrame, sources: int = N_SOURCES) -> DataFrame:
    """key, the four factors, ``capped`` and ``trust_score`` (0 to 100, two decimals).

    Without any result there is no evidence: the first factor is 0 and the score at most 25.
    """
    parts = (
        entities.select(key)
        .join(validation_factor(results, key), key, "left")
        .join(exception_factor(exceptions, key), key, "left")
        .join(source_factors(winners, key, sources), key, "left")
    )
    factor = {"validation": F.coalesce("validation", F.lit(0.0)), "exceptions": F.coalesce("exceptions", F.lit(100.0)), "coverage": F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(100.0)), "source_trust": F.coalesce("source_trust", F.lit(0.0))}
    total = sum((factor[f] * w for f, w in FACTORS.items()), F.lit(0.0))
    capped = F.col("n_results").isNull()
    score = F.when(capped, F.least(total, F.lit(UNPROVEN))).otherwise(total)
    return parts.select(key, *(c.alias(f) for f, c in factor.items()), capped.alias("capped"), F.round(F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0)), 2).alias("trust_score"))


def breakdown() -> Column:
    """Factors, weights and cap of a score row as one struct."""
    return F.struct(*(F.struct(F.col(f).alias("score"), F.lit(w).alias("weight")).alias(f) for f, w in FACTORS.items()), F.col("capped"))


def bucket(score: Column) -> Column:
    out = F.when(score >= BUCKETS[0][0], BUCKETS[0][1])
    for least, name in BUCKETS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def eligible(canonical: DataFrame, exceptions: DataFrame, key: str) -> DataFrame:
    """Entities with a canonical row and no open blocking exception."""
    blocked = exceptions.filter("status = 'open' and is_blocking").select(key).distinct()
    return canonical.join(blocked, key, "left_anti")


def to_verify(canonical: DataFrame, exceptions: DataFrame, verified: DataFrame | None, key: str, limit: int = 0) -> DataFrame:
    """Eligible entities that were never verified, the first ``limit`` by key if one is given."""
    ready = eligible(canonical, exceptions, key)
    if verified is not None:
        ready = ready.join(verified.select(key).distinct(), key, "left_anti")
    return ready.orderBy(key).limit(limit) if limit else ready


def new_versions(snapshots: DataFrame, verified: DataFrame | None, key: str) -> DataFrame:
    """Snapshots (key, content_hash, ...) that differ from the latest version, with the next version number."""
    if verified is None:
        return snapshots.withColumn("version", F.lit(1)).withColumn("prev_record_hash", F.lit(None).cast("string"))
    last = verified.groupBy(key).agg(F.max("version").alias("_v"), F.max_by("content_hash", "version").alias("_c"), F.max_by("record_hash", "version").alias("prev_record_hash"))
    joined = snapshots.join(last, key, "left").filter("_c is null or _c <> content_hash")
    return joined.withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v", "_c")


def verification_summary(canonical: DataFrame, exceptions: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """How many entities are verified, blocked, or left over."""
    blocked = exceptions.filter("status = 'open' and is_blocking").select(key).distinct().withColumn("_b", F.lit(True))
    done = verified.select(key).distinct().withColumn("_v", F.lit(True))
    joined = canonical.select(key).distinct().join(blocked, key, "left").join(done, key, "left")
    state = F.when(F.col("_v"), "verified").when(F.col("_b"), "blocked").otherwise("eligible")
    return joined.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def source_files(records: DataFrame, raw: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Files behind each entity, from its records' raw rows: (key, raw_file_id, sha256), each once."""
    walk = records.select(key, "raw_record_id").join(raw.select("raw_record_id", "raw_file_id"), "raw_record_id").join(files.select("raw_file_id", "sha256"), "raw_file_id")
    return walk.select(key, "raw_file_id", "sha256").distinct()

