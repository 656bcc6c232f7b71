"""WARC archive (operator 1): payload bytes stored once by a verified digest, record headers kept apart.

An archive is a folder with two tables. `payloads` has one row per distinct payload: SHA-256, SHA-1, length and the
bytes (zlib). `records` has one row per record: its exact header block and the SHA-256 of its payload. Records are
put together again by a join on the digest; every payload is hashed again on the way. `export_text` writes the
records of an archive as plain WARC 1.1 files.

Two payloads count as equal if SHA-256, SHA-1 and length agree; rows with one SHA-256 but another SHA-1 or length
end the write with an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import small_batches, staged, table, work_path

#: Payloads of so many bytes or more are written once; further records with them are revisits.
REVISIT = 1000
#: Records of one payload that one copy of it serves when records are put together.
FAN = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _id(col):
    return F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("null")), F.lit(">"))


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [zlib.compress(x.as_py(), 6) for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(packed, pa.binary())], names=b.schema.names)


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of pages (page_id, url, html) into the archive at path.

    A null html is an empty payload, a null url an empty target; a url with line ends, which a header can't hold, also
    stands there in hexadecimal digits, from which it is read. Of the records with one payload of REVISIT bytes
    or more, that with the largest page_id is the response (null ids are smaller than any; rows that repeat the
    largest id are all responses); the others are revisits that refer to it. Smaller payloads are all responses.
    Other columns are not read. An empty table gives an archive without records.
    """
    body = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("body", 256))).withColumn("sha1", F.sha1("body")).withColumn("size", F.length("body").cast("long"))
    packed = rows.select("sha256", "sha1", "size", "body").mapInArrow(_deflate, "sha256 binary, sha1 string, size long, body binary")
    payloads = packed.groupBy("sha256").agg(F.min("sha1").alias("sha1"), F.max("sha1").alias("sha1_"), F.min("size").alias("size"), F.max("size").alias("size_"), F.first("body").alias("body"))
    clash = (F.col("sha1") != F.col("sha1_")) | (F.col("size") != F.col("size_"))
    payloads = payloads.withColumn("size", F.when(clash, F.raise_error(F.lit("two payloads with one digest"))).otherwise(F.col("size")))
    payloads.select("sha256", "sha1", "size", "body").write.parquet(f"{path}/payloads")
    heads = staged(rows.select("page_id", "url", "sha256", "sha1", "size"), "heads")
    owner = heads.where(F.col("size") >= REVISIT).groupBy("sha256").agg(F.max("page_id").alias("owner"), F.lit(True).alias("large"))
    heads = heads.join(owner, "sha256", "left")
    revisit = F.coalesce(F.col("large") & ~F.col("page_id").eqNullSafe(F.col("owner")), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.lit(len(HTTP))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        F.when(F.col("url").rlike(r"[\r\n]"), line("X-Target-URI-Hex", F.hex(F.col("url").cast("binary")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _id(F.col("owner"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.when(revisit, http).otherwise(http + F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    heads.select(F.concat(header.cast("binary"), F.lit(HTTP)).alias("header"), "sha256", revisit.alias("revisit")).write.parquet(f"{path}/records")


def parse_header(header: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record's header block, and the bytes after it."""
    head, _, rest = header.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    return dict(x.split(": ", 1) for x in lines[1:]), rest


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(header, sha256, body or null) to records; checks digests and lengths."""
    for b in batches:
        out = []
        for header, sha256, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fields, http = parse_header(header)
            size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            record = header
            if fields["WARC-Type"] == "response":
                if body is None:
                    raise ValueError(f"no payload for {fields['WARC-Record-ID']}")
                payload = zlib.decompress(body)
                if hashlib.sha256(payload).digest() != sha256 or hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what was written")
                record += payload
            if len(record) - (len(header) - len(http)) != int(fields["Content-Length"]):
                raise ValueError(f"length of {fields['WARC-Record-ID']} is not what was written")
            page = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
            url = bytes.fromhex(fields["X-Target-URI-Hex"]).decode() if "X-Target-URI-Hex" in fields else fields["WARC-Target-URI"]
            out.append((page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), digest, size, record))
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "record"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, url, record_type, refers_to, payload_digest, payload_bytes, record (its exact bytes).

    Only responses need their payload. A payload of many small responses is joined in copies of FAN records each.
    """
    records = spark.read.schema("header binary, sha256 binary, revisit boolean").parquet(f"{path}/records")
    payloads = spark.read.schema("sha256 binary, sha1 string, size long, body binary").parquet(f"{path}/payloads")
    full = records.where("not revisit")
    many = full.groupBy("sha256").agg(F.ceil(F.count("*") / FAN).alias("copies")).where("copies > 1")
    spread = full.join(many, "sha256", "left").withColumn("part", F.pmod(F.xxhash64("header"), F.coalesce("copies", F.lit(1))))
    stored = payloads.join(many, "sha256", "left").select("sha256", "body", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("part"))
    joined = spread.join(stored, ["sha256", "part"], "left").select("header", "sha256", "body")
    rest = records.where("revisit").select("header", "sha256", F.lit(None).cast("binary").alias("body"))
    return joined.union(rest).mapInArrow(_assemble, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, record binary")


def export_text(records: DataFrame, path: str) -> None:
    """Writes records as .warc files: each record's bytes and two line ends. For payloads in UTF-8."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def op1_warc_archive(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d
"""
