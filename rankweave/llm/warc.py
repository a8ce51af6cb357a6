"""Content-addressed WARC archive.

Payload bytes are stored once per SHA-256; the exact header block of every record is
stored apart. Original records come back by joining headers with payloads on the
digest, and every payload is verified against its digest when it is read.

The payload store is one map-side-combined aggregation (`min_by` per digest), so a
payload that a third of all pages share is reduced before the shuffle. The joins
carry one row per page on one side and one row per digest on the other; adaptive
execution can split a hot digest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import configure, stage, table

CRLF = "\r\n"
_HEX32, _B32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four blocks of 40 bits, 8 digits each."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _B32)


@dataclass
class Archive:
    """headers: page_id, digest, header; payloads: digest, payload."""

    headers: DataFrame
    payloads: DataFrame


def write_archive(pages: DataFrame, min_bytes: int = 0, date: datetime | None = None, archive_id: str | None = None) -> Archive:
    """Archive page_id, url, html. Null html is an empty payload, null url an empty URI.

    Among records with equal payloads of at least ``min_bytes`` bytes the smallest
    page_id is the response, the rest revisit it. A null page_id sorts after all
    others. Repeated rows with the smallest page_id are all responses. Further columns
    are ignored. Every record bears ``date`` (the time of the call, if none is given) and
    an identifier made of ``archive_id`` (a new UUID, if none is given) and page_id;
    rows of one page_id share it. The block of a record is the payload alone, so its
    media type is the payload's.
    """
    if date is not None and date.tzinfo is None:
        raise ValueError("the date of an archive needs a time zone")
    when = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    archive_id = archive_id or str(uuid.uuid4())
    payload = F.coalesce("html", F.lit("")).cast("binary")
    records = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    store = stage(
        records.groupBy("digest").agg(
            F.min_by("payload", F.coalesce(F.col("page_id"), F.lit((1 << 63) - 1))).alias("payload"),
            F.min("page_id").alias("first_id"),
        ),
        "warc-payloads",
    )
    known = store.select("digest", "first_id", F.length("payload").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    urn = lambda c: F.concat(F.lit(f"<urn:x-page:{archive_id}:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = (F.col("n") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {when}{CRLF}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(
            F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit(f"{CRLF}WARC-Refers-To: "), urn(F.col("first_id")),
        )).otherwise(""),
        F.when(revisit, "").otherwise(f"{CRLF}Content-Type: text/html; charset=utf-8"),
        F.lit(f"{CRLF}Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string"),
        F.lit(CRLF + CRLF),
    )
    headers = stage(
        records.select("page_id", "url", "digest").join(known, "digest").select("page_id", "digest", header.alias("header")),
        "warc-headers",
    )
    return Archive(headers, store.select("digest", "payload"))


def read_archive(archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, declared digest, full payload, record bytes, and
    the block of the record: the bytes behind its header, as many as the header declares.

    A payload that no longer has its digest stops the job.
    """
    verified = archive.payloads.select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("payload does not match its digest")).cast("binary"))
        .alias("payload"),
    )
    kind = F.regexp_extract("header", r"\r\nWARC-Type: (\w+)", 1)
    refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:x-page:[^>]*:(-?\d+)>", 1)
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    length = F.regexp_extract("header", r"\r\nContent-Length: (\d+)\r\n\r\n$", 1).cast("int")
    record = F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return archive.headers.join(verified, "digest").select(
        "page_id", kind.alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("declared"),
        "payload",
        record.alias("record"),
        F.substring(record, F.octet_length("header") + 1, length).alias("block"),
    )


def op7_warc(spark, sf_dir):
    """Archive all pages, read the archive back, and digest what was read: of a response the
    block of its record, of a revisit the payload that its digest names.

    Null html is an empty payload. Repeated rows of the smallest page_id are all responses.
    """
    configure(spark)
    back = read_archive(write_archive(table(spark, sf_dir, "pages"), min_bytes=0))
    read = F.when(F.col("record_type") == "response", F.col("block")).otherwise(F.col("payload"))
    return back.withColumn("read", read).select(
        "page_id", F.length("read").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("read")).alias("payload_digest"), "record_type", "refers_to",
    )


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, sha256(b) AS s FROM p),
f AS (SELECT s, min(page_id) AS first_id FROM d GROUP BY s)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT) & 31::UBIGINT))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id OR page_id IS NULL THEN first_id END AS refers_to
FROM d JOIN f USING (s)
"""
