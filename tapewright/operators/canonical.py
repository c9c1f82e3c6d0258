"""Survivorship: one record per entity from its sources, field by field, with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import HUMAN
from .detect import latest


def candidates(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per (entity, source, field) that carries a value, from the latest version of each source.

    ``records``: key, source_system, version, optionally record_id, and the fields as columns.
    """
    columns = [key, "source_system", "version", *(["record_id"] if "record_id" in records.columns else []), *fields]
    newest = latest(records.select(*columns), [key, "source_system"], ["version"])
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields))
    return newest.select(key, "source_system", "version", *(["record_id"] if "record_id" in columns else []), F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def trusted(cells: DataFrame, trust: DataFrame) -> DataFrame:
    """``cells`` with the trust of their source in their field; unknown sources drop out.

    A trust for the very field goes before the source's trust for all others.
    """
    special = trust.filter("field_name is not null").select("source_system", "field_name", F.col("trust").alias("_special"))
    base = trust.filter("field_name is null").select("source_system", F.col("trust").alias("_base"))
    both = cells.join(special, ["source_system", "field_name"], "left").join(base, "source_system", "left")
    return both.withColumn("trust", F.coalesce("_special", "_base")).drop("_special", "_base").filter("trust is not null")


def blend(records: DataFrame, trust: DataFrame, key: str, fields: list[str], pins: DataFrame | None = None) -> DataFrame:
    """(key, field_name, value, source_system, trust, version, pinned): the winner of each field.

    The highest trust wins, ties go to the first source by name.  Pins (key, field_name,
    value, which may be null) stand above all sources.
    """
    cells = trusted(candidates(records, key, fields), trust).withColumn("pinned", F.lit(False))
    if pins is not None:
        cells = cells.unionByName(
            pins.select(key, "field_name", "value", F.lit(HUMAN).alias("source_system"), F.lit(100).alias("trust"), F.lit(True).alias("pinned")), allowMissingColumns=True
        )
    carried = [c for c in cells.columns if c not in (key, "field_name")]
    # trust downwards and names upwards in one comparable struct: a partial maximum, no window
    rank = F.struct((~F.col("pinned")).cast("int").alias("p"), (-F.col("trust")).alias("t"), F.col("source_system").alias("s"))
    won = cells.groupBy(key, "field_name").agg(F.min_by(F.struct(*carried), rank).alias("_x"))
    return won.select(key, "field_name", "_x.*")


def wide(winners: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per entity: its fields, and provenance as a map of structs."""
    values = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in fields]
    told = [c for c in ("source_system", "trust", "record_id", "version", "pinned") if c in winners.columns]
    provenance = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("field_name").alias("key"), F.struct(*told).alias("value")))))
    return winners.groupBy(key).agg(*values, provenance.alias("provenance"), F.count(F.lit(1)).alias("fields_blended"))


def as_maps(winners: DataFrame, key: str) -> DataFrame:
    """One row per entity with ``data``, ``provenance`` and ``pinned`` (the pins' values) as maps by field."""
    told = F.struct("source_system", "trust", "pinned")
    entries = lambda value: F.map_from_entries(F.collect_list(F.struct(F.col("field_name").alias("key"), value.alias("value"))))
    pins = F.map_from_entries(F.filter(F.collect_list(F.when(F.col("pinned"), F.struct(F.col("field_name").alias("key"), F.col("value").alias("value")))), lambda e: e.isNotNull()))
    return winners.groupBy(key).agg(entries(F.col("value")).alias("data"), entries(told).alias("provenance"), pins.alias("pinned"))


def upserted(previous: DataFrame | None, now: DataFrame, key: str) -> DataFrame:
    """The new state over the old one, both as ``as_maps`` gives them.

    Entities without new records stay as they are.  Pins of the old row stand over what sources
    say now, also where they say null or the sources no longer have the field; a pin that
    ``now`` brings goes before an older one.  Fields of the old row that nothing supports go.
    """
    if previous is None:
        return now
    old = previous.select(key, *(F.col(c).alias(f"_{c}") for c in ("data", "provenance", "pinned")))
    both = now.join(old, key, "full")
    older, newer = F.col("_pinned"), F.col("pinned")
    kept = F.when(older.isNull(), newer).when(newer.isNull(), older).otherwise(F.map_zip_with(older, newer, lambda k, a, b: F.when(F.map_contains_key(newer, k), b).otherwise(a)))
    both = both.withColumn("_pins", kept).withColumn("_new", F.col("data").isNotNull())
    pin = F.struct(F.lit(HUMAN).alias("source_system"), F.lit(100).alias("trust"), F.lit(True).alias("pinned"))
    pins = F.col("_pins")
    data = F.map_zip_with("data", pins, lambda k, v, p: F.when(F.map_contains_key(pins, k), p).otherwise(v))
    provenance = F.map_zip_with("provenance", pins, lambda k, v, p: F.when(F.map_contains_key(pins, k), pin).otherwise(v))
    return both.select(key, F.when(F.col("_new"), data).otherwise(F.col("_data")).alias("data"), F.when(F.col("_new"), provenance).otherwise(F.col("_provenance")).alias("provenance"), pins.alias("pinned"))


def newest_versions(rows: DataFrame, keys: list[str], order: str, n: int = 1) -> DataFrame:
    """The ``n`` newest rows of each key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
