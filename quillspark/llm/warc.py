"""A content-addressed WARC archive.

Payload bytes are stored once, under a strong digest that is verified when they are read; the exact headers of every
record (WARC and HTTP lines) are stored apart. Joining the two on the digest gives back each original record, byte for
byte. Of records with equal payloads the one with the largest id is the response; the others are revisits of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)
DATE = "2024-01-01T00:00:00Z"


def base32(hexadecimal: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hexadecimal string whose bits are a multiple of 40."""
    out = []
    for k in range(0, digits, 10):
        bits = F.conv(F.substring(hexadecimal, k + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)


@dataclass
class Archive:
    """Two tables in the shared folder: payloads (sha256, payload) and records (page_id, header, sha256)."""

    payloads: DataFrame
    records: DataFrame


def _hashed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col in pages.columns else F.lit("")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))


def _line(name: str, value: Column | str) -> list[Column]:
    return [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]


def _header(date: str) -> Column:
    """The exact header of a record: WARC lines, a blank line, and the HTTP head of its block."""
    record = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    uri = F.regexp_replace("url", r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\n"), *_line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))), *_line("WARC-Record-ID", record(F.col("page_id"))), *_line("WARC-Date", date), *_line("WARC-Target-URI", uri),
        F.when(F.col("revisit"), F.concat(*_line("WARC-Profile", PROFILE), *_line("WARC-Refers-To", record(F.col("refers_to"))))).otherwise(F.lit("")),
        *_line("Content-Type", "application/http;msgtype=response"), *_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), *_line("Content-Length", length.cast("string")), F.lit("\r\n"), http,
    )


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = DATE) -> Archive:
    """Write one record per row. Payloads under min_bytes are not shared: each such record is a response.

    Null payloads count as empty. A null id is the response only where a payload has no other id; rows that repeat the
    response's id and its payload are responses too. An empty table makes an empty archive.
    """
    rows = _hashed(pages, id_col, url_col, payload_col)
    small = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), base32(F.sha1("payload")).alias("digest"))
    # The largest id of each payload, found from digests alone; a hot payload is combined before it moves.
    first = small.groupBy("sha256").agg(F.max("page_id").alias("first_id"))
    typed = small.join(first, "sha256").withColumn("revisit", (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))).withColumn("refers_to", F.when(F.col("revisit"), F.col("first_id")))
    records = written(typed.select("page_id", _header(date).cast("binary").alias("header"), "sha256"), "warc-records")
    # By digest and id, so a hot payload is no hot key; repeated rows meet in the same partition, without another exchange.
    known = lambda c: F.coalesce(F.col(c), F.lit(_NO_ID)).alias("id")
    stored = rows.select("sha256", known("page_id"), "payload").join(first.select("sha256", known("first_id")), ["sha256", "id"], "left_semi")
    return Archive(written(stored.dropDuplicates(["sha256", "id"]).select("sha256", "payload"), "warc-payloads", compression="zstd"), records)


def verified(archive: Archive) -> DataFrame:
    """sha256, payload_bytes and payload_digest of each stored payload, computed from its bytes; a wrong digest raises."""
    right = F.sha2("payload", 256) == F.col("sha256")
    return archive.payloads.select(F.when(right, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("stored payload differs from its digest "), F.col("sha256")))).alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))


def reconstruct(archive: Archive) -> DataFrame:
    """page_id and the original record of each row: header, payload unless it is a revisit, and the closing lines."""
    text = F.decode("header", "UTF-8")
    payload = F.when(F.regexp_extract(text, r"\r\nWARC-Type: (\w+)", 1) == "response", F.col("payload")).otherwise(F.lit(b"").cast("binary"))
    return archive.records.join(archive.payloads, "sha256").select("page_id", F.concat("header", payload, F.lit(b"\r\n\r\n").cast("binary")).alias("record"))


def read_archive(archive: Archive) -> DataFrame:
    """One row per record, read from its header and its verified payload: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A header whose digest is not that of its payload raises."""
    text = F.decode("header", "UTF-8")
    named = lambda name, pattern: F.regexp_extract(text, rf"(?:^|\r\n){name}: {pattern}", 1)
    said = archive.records.select("sha256", named("WARC-Record-ID", "<urn:page:(-?\\d*)").alias("id"), named("WARC-Type", "(\\w+)").alias("record_type"), named("WARC-Refers-To", "<urn:page:(-?\\d*)").alias("to"), named("WARC-Payload-Digest", "sha1:(\\w+)").alias("digest"))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    digest = F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ in record "), F.col("id"))))
    return said.join(verified(archive), "sha256").select(number("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("to").alias("refers_to"))
