"""Reading source files, landing their rows, and making typed records of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts
from ..functions import coercion

SPARK_TYPES = {"str": "string", "status": "string", "date": "string", "ts": "string", "float": "double", "int": "bigint"}
RECORD_FIELDS = "struct<" + ",".join(f"{f}:{SPARK_TYPES[t]}" for f, t in contracts.FIELD_TYPES.items()) + ">"
ERRORS = "map<string,struct<raw:string,expected:string>>"


def resolve(header: str) -> str | None:
    """The canonical field that a header names, if any."""
    h = header.strip()
    h = contracts.HEADER_ALIASES.get(h, h)
    return h if h in contracts.FIELD_TYPES else None


def column_mapping(headers: list[str]) -> tuple[dict[str, str | None], list[str]]:
    """Header to field, in order, and the headers that name none."""
    mapping = {h: resolve(h) for h in headers}
    return mapping, [h for h, f in mapping.items() if f is None]


def read_lines(spark: SparkSession, path: str | list[str], headers: list[str]) -> DataFrame:
    """The rows of a CSV file, of a folder or a list of such files, as text columns; ``_file``, ``_row`` in
    that file's order and ``_error`` for ragged rows.

    Quoted cells may hold line ends; a byte-order mark and blank lines are skipped.  Rows
    with too few or too many cells are kept and marked.
    """
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*headers, "_raw"]])
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw", "enforceSchema": True}
    rows = spark.read.schema(schema).options(**options).csv(path)
    # without what stands between quotation marks (two together are a mark within), what is left of commas sets cells apart
    bare = F.regexp_replace(F.col("_raw"), '"[^"]*"', "")
    cells = F.when(F.col("_raw").isNotNull(), F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(","), F.lit(""))) + 1)
    extra = cells - len(headers)
    missing = F.array_join(F.slice(F.array(*map(F.lit, headers)), cells + 1, F.greatest(-extra, F.lit(0))), ",")
    error = F.when(F.col("_raw").isNotNull(), F.when(extra > 0, F.concat(extra.cast("string"), F.lit(" extra column(s) beyond header"))).otherwise(F.concat(F.lit("missing column(s): "), missing)))
    # Spark refuses queries that read the raw line alone, as counting errors would: an empty piece of a cell goes along
    error = F.concat(error, F.substring(F.coalesce(F.col(f"`{headers[0]}`"), F.lit("")), 1, 0))
    # one file is read by one task if its cells may hold line ends, so this order is the file's
    ordered = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    numbered = ordered.withColumn("_row", F.row_number().over(Window.partitionBy("_file").orderBy("_at")))
    return numbered.select("_file", "_row", *(F.when(F.col("_raw").isNull(), F.coalesce(F.col(f"`{h}`"), F.lit(""))).otherwise(F.col(f"`{h}`")).alias(h) for h in headers), error.alias("_error"))


def headers_of(spark: SparkSession, path: str) -> list[str]:
    """The header line of a CSV file."""
    return [c.lstrip("﻿") for c in spark.read.options(header=True, multiLine=True).csv(path).columns]


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file, sha256, length) of whole files; ``file`` is the name that ``read_lines`` gives them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def not_seen(files: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content no earlier upload had, failed ones aside."""
    if force:
        return files
    return files.join(registry.filter("status <> 'failed'").select("sha256").distinct(), "sha256", "left_anti")


def latest_upload(registry: DataFrame) -> DataFrame:
    """The newest upload that didn't fail, by content."""
    return registry.filter("status <> 'failed'").groupBy("sha256").agg(F.max_by(F.struct("raw_file_id", "status", "uploaded_at"), "uploaded_at").alias("x")).select("sha256", "x.*")


def landed(lines: DataFrame, raw_file_id: str | Column, kind: str, headers: list[str], by_file: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """Raw rows as they are stored: payload by header, error, and their file.

    The lines of a folder need ``by_file``: the name of each file then follows ``raw_file_id``.
    A column of ``lines`` may name each row's file instead; ``keep`` adds columns.
    """
    if kind not in contracts.FILE_SOURCES:
        raise ValueError(f"unknown file kind: {kind!r}")
    payload = F.map_from_arrays(F.array(*map(F.lit, headers)), F.array(*(F.col(f"`{h}`") for h in headers)))
    named = raw_file_id if isinstance(raw_file_id, Column) else F.lit(raw_file_id)
    file = F.concat_ws("#", named, F.element_at(F.split("_file", "/"), -1)) if by_file else named
    return lines.select(
        file.alias("raw_file_id"),
        F.col("_row").alias("row_number"),
        F.sha2(F.concat_ws("#", file, "_row"), 256).alias("raw_record_id"),
        F.lit(contracts.FILE_SOURCES[kind]).alias("source_system"),
        payload.alias("payload"),
        F.col("_error").alias("parse_error"),
        *(c.alias(name) for name, c in (keep or {}).items()),
    )


def counters(raw: DataFrame) -> DataFrame:
    """Rows in all, parsed and failed, by file."""
    bad = F.col("parse_error").isNotNull()
    return raw.groupBy("raw_file_id").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(~bad).alias("parsed_count"), F.count_if(bad).alias("failed_count"))


def progress(parsed: Column, total: Column, status: Column) -> Column:
    """Per cent done, rounded down."""
    return F.when(status == "completed", 100).when(F.coalesce(total, F.lit(0)) == 0, 0).otherwise(F.floor(parsed * 100 / total)).cast("int")


def coerced(field: str, raw: Column) -> tuple[Column, Column]:
    """(value, malformed) of one cell."""
    s, kind = coercion.stripped(raw), contracts.FIELD_TYPES.get(field, "str")
    if kind == "status":
        return coercion.to_status(s, contracts.PAYMENT_STATUS), F.lit(False)
    if kind == "str":
        return s, F.lit(False)
    if kind == "ts":
        t = coercion.to_time(s)
        # payloads keep times as ISO text
        return F.when(t.isNotNull(), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")), s.isNotNull() & t.isNull()
    value = {"float": coercion.to_double, "int": coercion.to_long, "date": coercion.to_iso_date}[kind](s)
    return value, s.isNotNull() & value.isNull()


def normalised(raw: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Typed records of parsed raw rows of one layout: data, field_errors, in_scope, effective_at.

    ``in_scope`` are the fields that the file declares.  Two headers may name one field; the
    later one wins.
    """
    source = {f: h for h, f in mapping.items() if f is not None}
    cells = {f: coerced(f, F.try_element_at("payload", F.lit(h))) for f, h in source.items()}
    nothing = {f: F.lit(None).cast(SPARK_TYPES[t]) for f, t in contracts.FIELD_TYPES.items()}
    data = F.struct(*((cells[f][0] if f in cells else nothing[f]).alias(f) for f in contracts.FIELD_TYPES))
    errors = [
        F.when(bad, F.struct(F.lit(f).alias("key"), F.struct(F.try_element_at("payload", F.lit(source[f])).alias("raw"), F.lit(contracts.FIELD_TYPES[f]).alias("expected")).alias("value")))
        for f, (_, bad) in cells.items()
        if contracts.FIELD_TYPES[f] not in ("str", "status")
    ]
    found = F.map_from_entries(F.filter(F.array(*errors), lambda e: e.isNotNull())) if errors else F.lit(None)
    effective = coercion.to_time(coercion.stripped(F.try_element_at("payload", F.lit(source["last_updated_at"])))) if "last_updated_at" in source else F.lit(None).cast("timestamp")
    out = raw.filter("parse_error is null")
    return out.select(
        "raw_record_id",
        "raw_file_id",
        "row_number",
        "source_system",
        data.alias("data"),
        F.coalesce(found.cast(ERRORS), F.create_map().cast(ERRORS)).alias("field_errors"),
        F.array(*map(F.lit, source)).cast("array<string>").alias("in_scope"),
        effective.alias("effective_at"),
        *(c for c in ("batch_no", "file_no") if c in raw.columns),
    )


def quarantined(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with a loan_id, and import_error exceptions for those without."""
    there = F.col("data.loan_id").isNotNull()
    errors = records.filter(~there).select(
        F.sha2(F.concat_ws("|", F.lit("import_error"), "raw_record_id"), 256).alias("exception_id"),
        "raw_record_id",
        F.lit(None).cast("string").alias("loan_id"),
        F.lit("import_error").alias("exception_type"),
        F.lit("HIGH").alias("severity"),
        F.lit(True).alias("is_blocking"),
        F.lit("open").alias("status"),
        F.lit("loan_id").alias("field_name"),
    )
    return records.filter(there), errors


def versioned(records: DataFrame, keys: list[str], order: list[str], base: DataFrame | None = None) -> DataFrame:
    """``version``: a running number per key in file order, on top of the highest one so far."""
    numbered = records.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if base is None:
        return numbered
    top = base.groupBy(*keys).agg(F.max("version").alias("_top"))
    return numbered.join(top, keys, "left").withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top")


def new_keys(records: DataFrame, key: str, carry: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """Keys not known yet, with ``carry`` from the first row that has them."""
    found = records.groupBy(key).agg(F.min_by(carry, order).alias(carry))
    return found if known is None else found.join(known.select(key), key, "left_anti")


def once_per_file(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Raw rows of files of which no record or import error exists yet."""
    return raw.join(done.select("raw_file_id").distinct(), "raw_file_id", "left_anti")


def export_csv(verified: DataFrame, fixed: list[str], canonical: str, path: str) -> None:
    flat_for_csv(verified, fixed, canonical).write.mode("overwrite").option("header", True).csv(path)


def flat_for_csv(verified: DataFrame, fixed: list[str], canonical: str) -> DataFrame:
    """Fixed columns, then the canonical fields; a canonical value of the same name takes the fixed one's place."""
    names = verified.schema[canonical].dataType.names
    first = [F.coalesce(F.col(f"{canonical}.{c}").cast("string"), F.col(c).cast("string")).alias(c) if c in names else F.col(c) for c in fixed]
    return verified.select(*first, *(F.col(f"{canonical}.{c}") for c in names if c not in fixed))


def flat_for_json(verified: DataFrame, fixed: list[str], canonical: str) -> DataFrame:
    """As above, but here the fixed columns win."""
    names = verified.schema[canonical].dataType.names
    return verified.select(*fixed, *(F.col(f"{canonical}.{c}") for c in names if c not in fixed))


def export_json(verified: DataFrame, fixed: list[str], canonical: str, path: str) -> None:
    flat_for_json(verified, fixed, canonical).write.mode("overwrite").json(path)
