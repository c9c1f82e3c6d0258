"""A content-addressed WARC archive: payloads once by digest, exact record headers apart.

``payloads`` holds each distinct payload under its SHA-256 (the "verified strong digest":
on reading, the digest is computed again and must agree); ``records`` holds one row a
record with the exact bytes of its WARC and HTTP headers and the payload's digest.  A
record's bytes are header + payload + two line ends, put together by a join.

Of records with equal payloads of at least ``least`` bytes, the one with the largest
page_id is the response and the others are revisits that refer to it and hold no payload
bytes of their own.  Both tables are Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five of them, twenty bits, are four characters."""
    chars = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            chars.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*chars)


def _lines(*lines: Column | str) -> Column:
    return F.concat(*(F.concat(x if isinstance(x, Column) else F.lit(x), F.lit(_END)) for x in lines))


def record_uri(page_id: Column, digest: Column) -> Column:
    """A record's id follows from its content, so a repeated run writes the same bytes."""
    h = F.sha2(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest), 256)
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in at)))


def write(pages: DataFrame, out: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as an archive of two tables under ``out``.

    A null html is an empty payload, a null url an empty one.  If several rows share the
    largest page_id of a payload (repeated rows), each of them is a response.  A payload
    whose page_ids are all null has responses only.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    # one row a digest; an equal payload may come from any of its rows
    stored = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("page_id").alias("largest"))
    stored = stored.select("sha256", "payload", "largest", F.octet_length("payload").cast("long").alias("size"), base32_of_hex(F.sha1("payload")).alias("sha1"))
    stored.write.parquet(f"{out}/payloads")
    known = pages.sparkSession.read.parquet(f"{out}/payloads").select("sha256", "largest", "size", "sha1")
    first = F.col("largest")
    kind = F.when((F.col("size") < least) | F.col("page_id").eqNullSafe(first), "response").otherwise("revisit")
    records = rows.select("page_id", "url", "sha256").join(known, "sha256").withColumn("kind", kind)
    revisit = F.col("kind") == "revisit"
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), "")
    records = records.withColumn("http", http)
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("size"))
    named = _lines(
        "WARC/1.1",
        F.concat(F.lit("WARC-Type: "), "kind"),
        F.concat(F.lit("WARC-Record-ID: <"), record_uri(F.col("page_id"), F.col("sha256")), F.lit(">")),
        f"WARC-Date: {date}",
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.concat(F.lit("WARC-Source-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    )
    refers = _lines(
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        F.concat(F.lit("WARC-Refers-To: <"), record_uri(first, F.col("sha256")), F.lit(">")),
        F.concat(F.lit("WARC-Refers-To-Page: "), first.cast("string")),
    )
    header = F.concat(named, F.when(revisit, refers).otherwise(F.lit("")), F.lit(_END), "http").cast("binary")
    records.select(header.alias("header"), "sha256").write.parquet(f"{out}/records")


def _field(name: str) -> Column:
    """A header field's value; "" if the record has none."""
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The archive's records from its two tables, with digests computed again from the stored payloads.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to and verified
    (whether the stored payload still has the digests and length it is filed under).
    """
    # per payload first, so that a payload which very many records share is read once
    kept = spark.read.parquet(f"{out}/payloads").select(
        "sha256", (F.sha2("payload", 256) == F.col("sha256")).alias("same"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest")
    )
    records = spark.read.parquet(f"{out}/records").join(kept, "sha256")
    number = lambda name: F.nullif(_field(name), F.lit("")).cast("long")
    agrees = F.col("same") & (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")) & (number("WARC-Payload-Length") == F.col("payload_bytes"))
    return records.select(
        number("WARC-Source-Page").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        "payload_bytes",
        "payload_digest",
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To-Page").alias("refers_to"),
        agrees.alias("verified"),
    )


def record_bytes(spark: SparkSession, out: str) -> DataFrame:
    """Each record as the bytes of a WARC file: (page_id, record_type, warc binary)."""
    payloads = spark.read.parquet(f"{out}/payloads").select("sha256", "payload")
    records = spark.read.parquet(f"{out}/records")
    end = F.lit(_END * 2).cast("binary")
    kind, page = _field("WARC-Type"), F.nullif(_field("WARC-Source-Page"), F.lit("")).cast("long")
    revisits = records.filter(kind == "revisit").select(page.alias("page_id"), kind.alias("record_type"), F.concat("header", end).alias("warc"))
    full = records.filter(kind == "response").join(payloads, "sha256")
    return full.select(page.alias("page_id"), kind.alias("record_type"), F.concat("header", "payload", end).alias("warc")).unionByName(revisits)


def write_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive ``pages`` and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    An empty table gives an empty archive; other columns are not read.  A payload that no longer
    has the digests and length it is filed under ends the job.
    """
    spark = pages.sparkSession
    out = new_path(spark, "warc")
    write(pages, out, least)
    return verified(read(spark, out)).drop("url")


def verified(records: DataFrame) -> DataFrame:
    """Records as ``read`` gives them; one that isn't verified ends the job."""
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id"))))
    return records.filter(F.when(F.coalesce("verified", F.lit(False)), True).otherwise(wrong))
