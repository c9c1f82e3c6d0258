"""Exceptions after they are found: clusters, decisions and their effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import FIELD_TYPES, HUMAN, SEVERITY_RANK
from ..sources.tapes import ERRORS, SPARK_TYPES, coerced

#: Clusters of exceptions that no rule found.
RULELESS = {"source_conflict": "Source conflicts", "import_error": "Import errors"}
ACCEPTING = ("accept", "edit", "manual_resolution")


def cluster_label(rule_code: Column, rule_version: Column, exception_type: Column) -> Column:
    fixed = F.create_map(*(F.lit(x) for kv in RULELESS.items() for x in kv))
    return F.when(rule_code.isNotNull(), F.concat(rule_code, F.lit(" v"), rule_version.cast("string"))).otherwise(F.coalesce(F.try_element_at(fixed, exception_type), exception_type))


def assign_clusters(exceptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exceptions with their cluster, and clusters with the number of open members (0 if none is left)."""
    label = cluster_label(F.col("rule_code"), F.col("rule_version"), F.col("exception_type"))
    has = F.col("cluster_id") if "cluster_id" in exceptions.columns else F.lit(None).cast("string")
    fresh = (F.col("status") == "open") & has.isNull()
    marked = exceptions.withColumn("_label", label).withColumn("cluster_id", F.when(fresh, F.sha2("_label", 256)).otherwise(has))
    clusters = marked.filter("cluster_id is not null").groupBy("cluster_id").agg(F.min("_label").alias("label"), F.count_if(F.col("status") == "open").alias("member_count"))
    return marked.drop("_label"), clusters


def carried(clusters: DataFrame, before: DataFrame | None) -> DataFrame:
    """Clusters of this run and those of earlier ones that have no member left, with 0."""
    if before is None:
        return clusters
    gone = before.join(clusters.select("cluster_id"), "cluster_id", "left_anti")
    return clusters.unionByName(gone.withColumn("member_count", F.lit(0).cast("long")).select(*clusters.columns))


def regrouped(clusters: DataFrame, changed: DataFrame) -> DataFrame:
    """Standing clusters after a batch of changes, without a look at the exceptions that didn't change.

    ``clusters``: cluster_id, label, member_count.  ``changed``: the exceptions that came, went or
    were decided, as ``assign_clusters`` takes them, with ``old_status`` and ``old_cluster_id`` (null for
    new ones).  Each moves the counts of the cluster it leaves and of the one it joins; clusters stay when they are empty.
    """
    label = cluster_label(F.col("rule_code"), F.col("rule_version"), F.col("exception_type"))
    has = F.coalesce("cluster_id", F.when(F.col("status") == "open", F.sha2(label, 256))) if "cluster_id" in changed.columns else F.coalesce("old_cluster_id", F.when(F.col("status") == "open", F.sha2(label, 256)))
    moves = changed.select(
        F.inline(
            F.array(
                F.struct(F.col("old_cluster_id").alias("cluster_id"), F.lit(None).cast("string").alias("label"), F.when(F.col("old_status") == "open", -1).otherwise(0).alias("n")),
                F.struct(has.alias("cluster_id"), label.alias("label"), F.when(F.col("status") == "open", 1).otherwise(0).alias("n")),
            )
        )
    ).filter("cluster_id is not null")
    delta = moves.groupBy("cluster_id").agg(F.max("label").alias("_label"), F.sum("n").alias("_n"))
    both = clusters.join(delta, "cluster_id", "full")
    return both.select("cluster_id", F.coalesce("label", "_label").alias("label"), (F.coalesce("member_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("member_count"))


def severity_rank(severity: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv)), severity)


def decided(exceptions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Exceptions with decisions applied: accepting ones resolve, a reject rejects.

    ``decisions``: exception_id, action, and for edits value.  An exception that was decided
    already, or is decided twice here, keeps its first decision (see ``refused``).
    """
    first = decisions.groupBy("exception_id").agg(F.min_by(F.struct("action", "decision_id"), "decided_at").alias("d"))
    joined = exceptions.join(first, "exception_id", "left")
    takes = F.col("d").isNotNull() & F.col("status").isin("open", "in_review")
    status = F.when(takes & F.col("d.action").isin(*ACCEPTING), "resolved").when(takes & (F.col("d.action") == "reject"), "rejected").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("decision_id", F.when(takes, F.col("d.decision_id"))).drop("d")


def refused(exceptions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on exceptions that are decided already."""
    return decisions.join(exceptions.filter(~F.col("status").isin("open", "in_review")).select("exception_id"), "exception_id", "left_semi")


def edit_effects(decisions: DataFrame, canonical: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pins that edits set, and their changes with the value that stood before them.

    ``decisions``: key, field_name, value, decided_at; ``canonical``: key, field_name, value.
    """
    last = decisions.groupBy(key, "field_name").agg(F.max_by("value", "decided_at").alias("value"))
    before = canonical.select(key, "field_name", F.col("value").alias("before"))
    changes = last.join(before, [key, "field_name"], "left").withColumn("source_system", F.lit(HUMAN))
    return last, changes


def human_records(edits: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """A record for each deciding edit, with nothing but the edited fields, to be validated like an imported one.

    ``edits``: loan_id, decision_id, decided_at, field_name, value (text), optionally position (in the
    decision's list).  Versions go on from the loan's human records in ``records``.  A field given
    twice in one decision takes the later value; two values at once end the job.
    ``validate.validate_records(..., origins=("human_edit",))`` runs the rules on them.
    """
    at = ["decided_at", *(["position"] if "position" in edits.columns else [])]
    shown = F.coalesce("value", F.lit(""))
    once = edits.groupBy("loan_id", "decision_id", "field_name", *at).agg(F.min("value").alias("value"), F.min(shown).alias("_least"), F.max(shown).alias("_most"))
    once = once.withColumn("value", F.when(F.col("_least") == F.col("_most"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("two values at once for "), "field_name"))))
    cells = once.groupBy("loan_id", "decision_id", "field_name").agg(F.max_by("value", F.struct(*at)).alias("value"), F.max("decided_at").alias("decided_at"))
    pairs = F.collect_list(F.struct("field_name", "value"))
    one = cells.groupBy("loan_id", "decision_id").agg(F.map_from_entries(pairs).alias("payload"), F.max("decided_at").alias("effective_at"))
    typed = {f: coerced(f, F.try_element_at("payload", F.lit(f))) for f in FIELD_TYPES}
    data = F.struct(*((F.col("loan_id").cast("string") if f == "loan_id" else value.cast(SPARK_TYPES[FIELD_TYPES[f]])).alias(f) for f, (value, _) in typed.items()))
    bad = [F.when(wrong, F.struct(F.lit(f).alias("key"), F.struct(F.try_element_at("payload", F.lit(f)).alias("raw"), F.lit(FIELD_TYPES[f]).alias("expected")).alias("value"))) for f, (_, wrong) in typed.items()]
    number = F.row_number().over(Window.partitionBy("loan_id").orderBy("effective_at", "decision_id"))
    out = one.select(
        "loan_id", "decision_id", F.lit(None).cast("string").alias("raw_record_id"), F.lit(HUMAN).alias("source_system"), number.alias("version"), data.alias("data"),
        F.map_from_entries(F.filter(F.array(*bad), lambda e: e.isNotNull())).cast(ERRORS).alias("field_errors"),
        F.array_sort(F.map_keys("payload")).alias("in_scope"), F.lit("human_edit").alias("origin"), "effective_at",
    )
    if records is None:
        return out
    top = records.filter(F.col("source_system") == HUMAN).groupBy("loan_id").agg(F.max("version").alias("_top"))
    return out.join(top, "loan_id", "left").withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top")


def agreement(recommendation: Column, action: Column, stated: Column) -> Column:
    """Whether a reviewer agreed with a cited recommendation; accepting or editing without a word is agreement."""
    return F.when(stated.isNotNull(), stated).when(recommendation.isNotNull() & action.isin("accept", "edit"), F.lit(True))


def corrections_requested(decisions: DataFrame) -> DataFrame:
    """Loans that go back to review: rejects that ask for a correction."""
    return decisions.filter("action = 'reject' and request_correction").select("loan_id").distinct().withColumn("status", F.lit("in_review"))


def batch(exceptions: DataFrame, ids: list[str] | None = None, rule_code: str | None = None, exception_type: str | None = None, severity: str | None = None) -> DataFrame:
    """Open exceptions picked by id, or by rule, type and severity."""
    open_ = exceptions.filter("status = 'open'")
    if ids is not None:
        return open_.filter(F.col("exception_id").isin(ids))
    for column, value in (("rule_code", rule_code), ("exception_type", exception_type), ("severity", severity)):
        if value is not None:
            open_ = open_.filter(F.col(column) == value)
    return open_


def batch_counts(picked: DataFrame, batch_id: str) -> DataFrame:
    """One audit line a loan of a batch decision."""
    return picked.filter("loan_id is not null").groupBy("loan_id").agg(F.count(F.lit(1)).alias("n_exceptions")).withColumn("batch_id", F.lit(batch_id))
