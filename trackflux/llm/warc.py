"""WARC archives with revisit records.

Records are written by Spark's own text writer (so tasks that are run again leave one copy,
and any file system will do): a row holds some whole records, each row becomes one gzipped file, and the writer's
line end closes its last record. Headers alone are shuffled by payload digest;
a record whose payload another record has already is written as a revisit without payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackflux.functions.storage import scratch_path
from trackflux.llm import columns as col
from trackflux.llm.frames import small, staged, thin_batches

END = b"\r\n\r\n"
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2024-01-01T00:00:00Z"
HEADERS = "record_id bigint, uri string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(record_id, uri, kind: str, payload: bytes, payload_digest: str, payload_bytes: int, refers_to) -> bytes:
    """One record with fresh headers. A missing id or URI has no header line."""
    block = payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {STAMP}"]
    lines += [f"WARC-Record-ID: <urn:record:{record_id}>"] if record_id is not None else []
    lines += [f"WARC-Target-URI: {_line(uri)}"] if uri is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def parse(raw: memoryview | bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    raw, at = bytes(raw), 0
    while at < len(raw):
        stop = raw.index(END, at)
        head = raw[at:stop].decode().split("\r\n")
        if head[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
        start = stop + len(END)
        after = start + int(fields["Content-Length"])
        if raw[after:after + len(END)] != END:
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, raw[start:after]
        at = after + len(END)


def write(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records (HEADERS and ``payload``) as archives of about ``archive_bytes`` before compression."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in col.slices(batches, "payload"):
            for r in batch.to_pylist():
                held.append(record(r["record_id"], r["uri"], r["record_type"], r["payload"] or b"", r["payload_digest"], r["payload_bytes"], r["refers_to"]))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["value"])

    names = [f.split()[0] for f in HEADERS.split(", ")]
    rows = records.select(*names, F.col("payload").cast("binary")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option(
        "compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives in ``path``: HEADERS, and ``payload`` (binary; empty for revisits).

    Length and digest of a response are taken from its block and held against its headers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["record_id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.binary()] * payload

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], fields)

        number = lambda v: int(v.split(":")[-1].rstrip(">")) if v else None
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                rows, size = [], 0
                for head, block in parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw):
                    told, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (digest(block) != told or len(block) != length):
                        raise ValueError(f"payload of {head.get('WARC-Record-ID')} does not fit its headers")
                    row = (number(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), head["WARC-Type"], told, length, number(head.get("WARC-Refers-To")))
                    rows.append(row + (block,) * payload)
                    size += len(block)
                    if size >= col.SLICE_BYTES or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, HEADERS + ", payload binary" * payload)


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One response record per page; a null payload is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in col.slices(batches, "payload"):
            found = [digest(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "payload_digest"])

    rows = pages.select(F.col(page_id).cast("bigint").alias("record_id"), F.col(url).cast("string").alias("uri"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    return thin_batches(rows).mapInArrow(run, "record_id bigint, uri string, payload binary, payload_digest string").select(
        "record_id", "uri", F.lit("response").alias("record_type"), "payload_digest", F.length("payload").cast("bigint").alias("payload_bytes"),
        F.lit(None).cast("bigint").alias("refers_to"), "payload")


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record_id, payload_digest, original): the record that a record with equal payload shall refer to.

    Only headers are shuffled. Of records with equal digest and length the largest id is the original;
    payloads under ``min_bytes`` and records without id stay responses and are not listed.
    """
    known = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("record_id").isNotNull())
    groups = known.groupBy("payload_digest", "payload_bytes").agg(F.max("record_id").alias("original"), F.min("record_id").alias("least")).where("original > least")
    groups = staged(groups.drop("least"), "originals")
    return known.join(small(groups), ["payload_digest", "payload_bytes"]).where("record_id < original").select("record_id", "payload_digest", "original").distinct()


def dedup(spark: SparkSession, source: str, target: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Read archives, resolve revisits and write them without repeated payloads.

    A revisit that is in the archives already is joined to its original by digest, so that it may itself
    become a reference target's neighbour with fresh headers: it stays a revisit, of the original with the largest id.
    """
    headers = staged(read(spark, source, payload=False), "headers")
    again = staged(resolve(headers, min_bytes), "revisits")
    renamed = small(again.select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), "original"))
    records = read(spark, source)
    # an original must carry its payload: a revisit with the largest id gets it from a response with equal digest
    bare = headers.where("record_type = 'revisit'").join(again, ["record_id", "payload_digest"], "left_anti").select("record_id", "payload_digest")
    bare = staged(bare, "bare")
    if not bare.isEmpty():
        lent = records.where("record_type = 'response'").join(small(bare.select("payload_digest").distinct()), "payload_digest", "left_semi")
        lent = lent.groupBy("payload_digest").agg(F.min("payload").alias("_payload"))
        lost = small(bare.select(F.col("record_id").alias("_b_id"), F.col("payload_digest").alias("_b_digest")))
        needs = records.join(lost, (F.col("record_id") == F.col("_b_id")) & (F.col("payload_digest") == F.col("_b_digest")), "left")
        lent = lent.withColumnRenamed("payload_digest", "_l_digest")
        full = needs.where("_b_id is not null").join(lent, F.col("payload_digest") == F.col("_l_digest"), "left").select(
            "record_id", "uri", F.when(F.col("_payload").isNotNull(), F.lit("response")).otherwise(F.col("record_type")).alias("record_type"),
            "payload_digest", "payload_bytes", "refers_to", F.coalesce("_payload", "payload").alias("payload"))
        records = needs.where("_b_id is null").select(*full.columns).unionByName(full)
    fresh = records.join(renamed, (F.col("record_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    repeat = F.col("original").isNotNull()
    write(fresh.select("record_id", "uri", F.when(repeat, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"), "payload_digest",
                       "payload_bytes", F.when(repeat, F.col("original")).otherwise(F.col("refers_to")).alias("refers_to"),
                       F.when(repeat, F.lit(b"")).otherwise(F.col("payload")).alias("payload")), target, archive_bytes)


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page, write the archives again without repeated payloads, and read those back (HEADERS).

    Null html is an empty payload; equal pages with one id are one payload's equal records and all stay responses
    unless a larger id has the payload too; a page without id is always a response.
    """
    spark = pages.sparkSession
    raw, slim = scratch_path(spark, "crawl"), scratch_path(spark, "slim")
    write(from_pages(pages), raw, archive_bytes)
    dedup(spark, raw, slim, min_bytes, archive_bytes)
    return read(spark, slim, payload=False)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS original FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < original THEN original END AS refers_to
FROM bits
"""
