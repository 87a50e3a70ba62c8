"""WARC archives of pages: revisit records for repeated payloads, and reading back with revisits resolved."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, join_ids, scratch_path, written

_EOL = "\r\n"
#: Payloads of up to so many bytes, and how many of these records a file holds at most. A reader takes a file as one row, so
#: files have about 128 MB at most, or one record.
FILES = ((1 << 16, 2000), (1 << 20, 128), (1 << 24, 8), (1 << 62, 1))
HEADERS = "page_id long, url string, record_type string, payload_digest string, refers_to long, content_length long"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: ten hexadecimal digits at a time are eight of base 32."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _record(kind: str, date: str, body: Column, salt: Column) -> Column:
    """The text of one record without the blank lines that end it. Header values can't hold line ends."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(F.regexp_replace(value.cast("string"), r"[\r\n]", "%0A"), F.lit("")), F.lit(_EOL))
    maybe = lambda name, value: F.when(value.isNotNull(), line(name, value)).otherwise(F.lit(""))
    ident = F.regexp_replace(F.md5(salt), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    revisit = []
    if kind == "revisit":
        revisit = [
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + _EOL),
            maybe("WARC-Refers-To-Target-URI", F.col("refers_url")),
            F.lit(f"WARC-Refers-To-Date: {date}{_EOL}"),
            line("Refers-To-Page-ID", F.col("refers_to")),
        ]
    return F.concat(
        F.lit("WARC/1.1" + _EOL),
        F.lit(f"WARC-Type: {kind}{_EOL}"),
        line("WARC-Record-ID", ident),
        F.lit(f"WARC-Date: {date}{_EOL}"),
        line("WARC-Target-URI", F.col("url")),
        maybe("Page-ID", F.col("page_id")),
        *revisit,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.lit("Content-Type: text/html" + _EOL),
        line("Content-Length", F.octet_length(body)),
        F.lit(_EOL),
        body,
    )


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_digest, refers_to and refers_url for each repeat: rows (page_id, url, payload_digest, payload_bytes) whose payload of at least min_bytes also has a larger page_id.

    Only headers are shuffled: digests are aggregated map-side before they meet, so a payload that a third of all pages
    share is a few rows; the join back is one that Spark can split. Null ids never refer nor are referred to.
    """
    h = pages.select("page_id", "url", "payload_digest", "payload_bytes").where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    last = h.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("_last"), F.min("page_id").alias("_least")).where("_last.page_id > _least")
    last = last.select("payload_digest", F.col("_last.page_id").alias("refers_to"), F.col("_last.url").alias("refers_url"))
    return h.join(last, "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to", "refers_url").distinct()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, files: tuple = FILES, date: str | None = None) -> None:
    """Write one record per row of pages (page_id, url, html) to gzip files below path.

    Of equal payloads of min_bytes or more, the one with the largest page_id is the response and the others are revisits
    without a body. Null html is an empty payload. Rows with the largest page_id that are repeated are each a response; a
    null page_id is always one. An empty table writes no record. date (by default now, UTC) is the WARC-Date of all records;
    every record has an id of its own.

    Headers (with digests) are stored first and alone decide what is a revisit; revisit records are made from them. Payloads
    of responses go from the input to the files; they are shuffled only if there are too many revisits to broadcast their keys.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("_payload"))
    p = p.withColumn("payload_bytes", F.octet_length("_payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("_payload")))
    headers = written(p.drop("_payload"), "headers")
    again = written(resolve(headers, min_bytes), "revisits")
    run, number = uuid4().hex, F.monotonically_increasing_id()
    repeats = headers.join(again, ["page_id", "payload_digest"]).withColumn("_salt", F.concat_ws(" ", F.lit(f"{run} revisit"), number))
    records = [repeats.select(_record("revisit", date, F.lit(""), F.col("_salt")).alias("value"))]
    responses = join_ids(p, again, ["page_id", "payload_digest"], "left_anti")
    least, sizes = 0, headers.agg(*[F.count_if(F.col("payload_bytes") <= most) for most, _ in files]).first()
    for (most, per_file), below, before in zip(files, sizes, [0, *sizes], strict=False):
        if below > before or not least:
            part = responses if below == sizes[-1] and not before else responses.where((F.col("payload_bytes") <= most) & (F.col("payload_bytes") > least - 1))
            part = part.withColumn("_salt", F.concat_ws(" ", F.lit(f"{run} {most}"), number))
            records.append(part.select(_record("response", date, F.col("_payload"), F.col("_salt")).alias("value")))
            out = records[0] if len(records) == 1 else records[0].unionByName(records[1])
            # Every record ends with two line ends, which the text writer puts after each row.
            out.write.mode("append").option("lineSep", _EOL * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
            records = []
        least = most + 1
    discard(headers, again)


def _records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of a file, unpacked as they are reached."""
    with gzip.open(io.BytesIO(packed)) as f:
        while f.readline():
            fields = {}
            while (line := f.readline()) != b"\r\n":
                name, value = line[:-2].decode().split(": ", 1)
                fields[name] = value
            yield fields, f.read(int(fields["Content-Length"]))
            f.read(4)


def _headers(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = lambda v: int(v) if v else None
    for frame in files:
        for packed in frame["content"]:
            rows = []
            for fields, body in _records(packed):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                rows.append((number(fields.get("Page-ID")), fields["WARC-Target-URI"], fields["WARC-Type"], digest, number(fields.get("Refers-To-Page-ID")), len(body)))
            out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "refers_to", "content_length"])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records of the archives below path; response payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_headers, HEADERS)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """read_headers() plus payload_bytes: of revisits, that of the response with the same digest that they refer to."""
    h = read_headers(spark, path)
    first = h.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("content_length").alias("_full"))
    direct = h.where("record_type = 'response'").withColumn("payload_bytes", F.col("content_length"))
    again = h.where("record_type = 'revisit'").join(first, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("_full")).select(*direct.columns)
    return direct.unionByName(again)


def roundtrip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archives to path (a fresh folder in the shared one by default) and read them back, revisits resolved."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_resolved(pages.sparkSession, path)
