"""Operator 5: a content-addressed WARC archive.

Two Parquet tables in a shared folder make up an archive:

* ``payloads``: the bytes of every different payload, once, under a strong digest
  (SHA-256).  Equal digests are not believed: the bytes of the group are compared.
* ``records``: per record its exact header block, its HTTP header and the digest of
  its payload.  Of the records of one payload the one with the largest id is a
  ``response``; the others are ``revisit`` records that name it.

``read_records`` joins the two again and gives the records byte for byte; ``read_index``
puts them together the same way and takes what it returns from them.  All of
it is DataFrame work; the payload bytes are shuffled once, when written, and the
copies of a hot payload are merged before that shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.session import ensure_checkpoint_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: digits of base 32 as conv() writes them
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of binary ``payload``: 20 bits at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _one_line(c: Column) -> Column:
    """A header value never ends its line."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def new_archive(spark: SparkSession) -> str:
    """A fresh folder for an archive below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """pages(page_id, url, html) -> the tables ``payloads`` and ``records`` below ``path``.

    The payload is the html in UTF-8 (null: empty).  Payloads below ``min_bytes`` are
    stored like any other but their records are all responses.  A null url gives no target
    header; rows with a null page_id are written as responses unless an id of
    their payload is known; repeated rows of one page_id give equal records.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    (rows.select(F.sha2("payload", 256).alias("sha256"), "payload")
     .groupBy("sha256").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
     .select("sha256", F.when(F.col("payload") == F.col("other"), F.col("payload"))
             .otherwise(F.raise_error(F.lit("two payloads with one SHA-256"))).alias("payload"))
     .select("sha256", base32_sha1(F.col("payload")).alias("payload_digest"),
             F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    named = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"),
                        base32_sha1(F.col("payload")).alias("digest"),
                        F.octet_length("payload").cast("long").alias("n"))
    keeper = named.groupBy("sha256").agg(F.max("page_id").alias("keeper"))
    records = named.join(keeper, "sha256", "left")
    revisit = (F.col("n") >= min_bytes) & (F.col("keeper") != F.col("page_id"))
    records = records.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    block = F.format_string(HTTP_HEADER, F.col("n"))
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    length = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: "), record_id(F.col("page_id")),
        F.coalesce(F.concat(F.lit(CRLF + "WARC-Target-URI: "), _one_line(F.col("url"))), F.lit("")),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("revisit"), F.concat(
            F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  + CRLF + "WARC-Refers-To: "), record_id(F.col("keeper")))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        length.cast("string"), F.lit(CRLF + CRLF))
    (records.withColumn("http", block).select("page_id", header.alias("header"), "http", "sha256")
     .write.parquet(f"{path}/records"))


def _header_field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def _joined(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, http, payload_digest (as named by the header), record_type, refers_to, sha256,
    block (what a record holds of its payload) and payload, of every record."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    kind = _header_field("WARC-Type")
    return spark.read.parquet(f"{path}/records").join(payloads, "sha256", "left").select(
        "page_id", "header", "http", "sha256", "payload", kind.alias("record_type"),
        F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")).alias("block"))


def _record() -> Column:
    """The bytes of a whole WARC record."""
    return F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), "block", F.lit(b"\r\n\r\n"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """What an archive says of its records, taken from the reconstructed records.

    page_id, payload_bytes, payload_digest (both of the full payload as joined), record_type,
    refers_to.  Every record is put together from header, HTTP block and payload.  It is an
    error if a payload is missing or does not have the digest it is stored under or its
    header names, or if the bytes of a record do not have the lengths that its WARC header
    and its HTTP header give.
    """
    rows = _joined(spark, path).withColumn("record", _record())
    said = F.replace(_header_field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit(""))
    at = F.octet_length("header")       # the record's content begins there
    length = _header_field("Content-Length").cast("long")
    named = F.regexp_extract("http", r"\r\nContent-Length: (\d+)\r", 1).cast("long")
    body = F.substring("record", at + F.octet_length("http") + 1, F.octet_length("block"))
    rows = rows.select(
        "page_id", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), said.alias("said"),
        F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1).alias("to"),
        ((F.sha2("payload", 256) == F.col("sha256")) & (body == F.col("block")) & (named == F.octet_length("payload"))
         & (F.octet_length("record") == at + length + 4)
         & (F.substring("record", at + length + 1, F.lit(4)) == F.lit(b"\r\n\r\n"))).alias("whole"))
    ok = F.col("whole") & (F.col("said") == F.col("payload_digest"))
    return rows.select(
        "page_id", F.when(ok, F.col("payload_bytes")).otherwise(
            F.raise_error(F.lit("a record does not match its digest or lengths")).cast("long")).alias("payload_bytes"),
        "payload_digest", "record_type",
        F.when(F.col("to") != "", F.col("to")).cast("long").alias("refers_to"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the bytes of the whole WARC record), payload (its full payload)."""
    return _joined(spark, path).select("page_id", _record().alias("record"), "payload")


def oracle_sql() -> str:
    """DuckDB twin of the index over the table pages."""
    digits = " || ".join(
        f"substr('{BASE32}', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {s}) & 31)::INT, 1)"
        for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
u AS (SELECT page_id, p, sha1(p) AS h, max(page_id) OVER (PARTITION BY p) AS k FROM t)
SELECT page_id, octet_length(encode(p)) AS payload_bytes, {digits} AS payload_digest,
       CASE WHEN k = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k <> page_id THEN k END AS refers_to FROM u"""
