"""WARC records over a content-addressed archive.

The archive is two tables: payload bytes, stored once under their SHA-256, and the exact header
of every record with the digest of its payload. A record is put together again by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.text import let
from clausewise.llm.common import staged

CRLF = "\r\n"
# fixed values: the alphabet of base32
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass
class Archive:
    """``payloads``: payload_sha256, payload. ``headers``: payload_sha256, header (one row per record)."""

    payloads: DataFrame
    headers: DataFrame


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: every five hex digits are four letters."""
    def letters(hexed: Column, group: Column) -> Column:
        bits = F.conv(F.substring(hexed, group * 5 + 1, 5), 16, 10).cast("int")
        return F.concat(
            *[F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, 1) for s in (15, 10, 5, 0)]
        )

    # the digest is bound first: a column named inside the groups would be digested for each of them
    return let(F.sha1(data), lambda hexed: F.concat(*[letters(hexed, F.lit(group)) for group in range(8)]))


def _one_line(value: Column) -> Column:
    """Header values keep to one line; CR and LF are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def archive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Write one record per row of ``pages``; equal payloads of at least ``min_bytes`` are stored once.

    Of such records the one with the smallest page_id is the response, the rest revisit it;
    records with a smaller payload are all responses. Null html is an empty payload, a null url
    leaves its header line out, a null page_id is never the smallest. Rows that repeat the
    response's page_id and payload are responses too. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("payload_sha256", F.unhex(F.sha2("payload", 256)))
    payloads = staged(
        keyed.groupBy("payload_sha256").agg(F.first("payload").alias("payload")), "warc-payloads"
    )
    facts = keyed.select(
        "page_id",
        "url",
        "payload_sha256",
        F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    # only digests and ids are grouped and joined; copies of one payload meet as one row per task
    firsts = (
        keyed.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("payload_sha256")
        .agg(F.min("page_id").alias("first_id"))
        .select(F.col("payload_sha256").alias("digest"), "first_id")
    )
    told = facts.join(firsts, F.col("payload_sha256") == F.col("digest"), "left")
    revisit = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))

    def urn(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))

    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    headers = staged(told.select("payload_sha256", header.alias("header")), "warc-headers")
    return Archive(payloads, headers)


def verified(stored: Archive) -> DataFrame:
    """The payloads, each checked against the digest it is filed under."""
    right = F.unhex(F.sha2("payload", 256)) == F.col("payload_sha256")
    return stored.payloads.select(
        "payload_sha256",
        F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest"))).alias("payload"),
    )


def records(stored: Archive) -> DataFrame:
    """The bytes of every record: header, payload (none in a revisit), two line ends; and the original payload."""
    whole = stored.headers.join(verified(stored), "payload_sha256")
    body = F.when(F.col("header").contains("WARC-Type: revisit"), F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), body, F.lit((CRLF + CRLF).encode()))
    return whole.select("header", record.alias("record"), "payload")


def field(name: str) -> Column:
    """A header's value; null where the line is missing."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(F.col("header").contains(f"{CRLF}{name}: "), found)


def read_back(stored: Archive) -> DataFrame:
    """One row per record, from the archive alone; payloads are measured once, before the join."""
    measured = verified(stored).select(
        "payload_sha256",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )

    def number(name: str) -> Column:
        return F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")

    return stored.headers.join(measured, "payload_sha256").select(
        number("WARC-Record-ID").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Type") == "revisit", number("WARC-Refers-To")).alias("refers_to"),
    )
