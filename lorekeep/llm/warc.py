"""Content-addressed WARC archive.

An archive is two tables in one folder.  ``payloads`` holds the bytes of each distinct payload once, under
its SHA-256.  ``records`` holds the exact header bytes of each record (WARC header and HTTP header) and the
digest of its payload.  Reading joins the two: every stored payload is hashed again and must agree with its
address and with the digest in every header that names it, else the read fails.

Of the records with one payload the one with the smallest ``page_id`` is a ``response``; the others are
``revisit`` records that refer to it.  Payloads shorter than ``least_bytes`` are never revisited.

Rows and edge cases: a null payload is empty.  A null ``page_id`` comes last, and its record has no page header,
so it reads back as null; of rows that repeat a ``page_id`` one is taken first, the others revisit it.  Control
characters and spaces of a url are percent-encoded in the header; a null url has no target header.  Extra columns
are ignored, and an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep.llm.common import read
from lorekeep.operators.first_wins import attach_per_key
from lorekeep.session import stage, staging_root

LEAST_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LINE = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: four times 40 bits, written in base 32 and put into the other alphabet."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE)), F.lit(""))


def _urn(page_id: Column, seq: Column) -> Column:
    digest = F.md5(F.concat_ws("/", page_id.cast("string"), seq.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _target(url: Column) -> Column:
    found = url
    for code in [*range(0x21), 0x7F]:
        found = F.replace(found, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), found).otherwise(url)


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Writes ``records`` and ``payloads`` under ``path`` from ``page_id``, ``url`` and ``html``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    hashed = stage(
        pages.select(
            F.monotonically_increasing_id().alias("seq"),
            F.col("page_id").cast("bigint").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.sha2(payload, 256).alias("address"),
            base32(F.sha1(payload)).alias("sha1"),
            F.octet_length(payload).cast("bigint").alias("bytes"),
        ),
        "warc-digests",
    )
    order = F.struct(F.col("page_id").isNull(), "page_id", "seq")
    firsts = stage(
        hashed.groupBy("address").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "warc-firsts"
    )
    rows = attach_per_key(hashed, firsts.select("address", "n", "first"), "address")
    revisit = (F.col("seq") != F.col("first.seq")) & (F.col("bytes") >= least_bytes)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"),
        _field("Content-Length", F.col("bytes")),
        F.lit(LINE),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{LINE}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(F.col("page_id"), F.col("seq"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", _target(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Profile", F.when(revisit, PROFILE)),
        _field("WARC-Refers-To", F.when(revisit, _urn(F.col("first.page_id"), F.col("first.seq")))),
        _field("Page-ID", F.col("page_id")),
        _field("Refers-To-Page-ID", F.when(revisit, F.col("first.page_id"))),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}"),
        _field("Content-Length", block),
        F.lit(LINE),
    )
    rows.select("seq", "address", header.cast("binary").alias("header"), http.cast("binary").alias("http_header")).write.parquet(
        f"{path}/records"
    )
    held = pages.select(F.sha2(payload, 256).alias("address"), payload.alias("payload"))
    held.groupBy("address").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies")).write.parquet(
        f"{path}/payloads"
    )


def _header(name: str, text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads whose bytes still hash to their address."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("address")
    return stored.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its address"))))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Each record's header fields, with length and digest of its payload as computed from the stored bytes."""
    proved = _payloads(spark, path).select(
        "address",
        F.col("copies").alias("n"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )
    proved = stage(proved, "warc-proved")
    records = spark.read.parquet(f"{path}/records")
    found = attach_per_key(records, proved, "address").withColumn("text", F.decode("header", "UTF-8"))
    same = _header("WARC-Payload-Digest", F.col("text")) == F.concat(F.lit("sha1:"), "payload_digest")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload does not match a header")))
    return found.select(
        _header("Page-ID", F.col("text")).cast("bigint").alias("page_id"),
        "payload_bytes",
        digest.alias("payload_digest"),
        _header("WARC-Type", F.col("text")).alias("record_type"),
        _header("Refers-To-Page-ID", F.col("text")).cast("bigint").alias("refers_to"),
        _header("WARC-Record-ID", F.col("text")).alias("record_id"),
        _header("WARC-Target-URI", F.col("text")).alias("target_uri"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, record, payload)``: the original bytes of each record and of the payload it stands for."""
    records = spark.read.parquet(f"{path}/records")
    payloads = _payloads(spark, path).select("address", F.col("copies").alias("n"), "payload")
    found = attach_per_key(records, payloads, "address")
    revisit = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return found.select("seq", F.concat("header", "http_header", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_headers(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with hashed as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
firsts as (select html, min(page_id) as first from hashed group by html)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', cast(1 + (
        (cast('0x' || substr(h || '0', 1 + cast(i * 5 // 4 as bigint), 2) as integer) >> cast(3 - (i * 5) % 4 as integer)) & 31) as bigint), 1)), '')
        as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type,
    case when page_id <> first then first end as refers_to
from hashed join firsts using (html)"""
