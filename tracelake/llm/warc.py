"""A content-addressed WARC archive: payload bytes once each, exact record headers apart, records rebuilt by joins.

``payloads`` holds each distinct payload under its SHA-256; ``headers`` holds, for every record, the exact header text and
the address of its payload. Equal payloads are found by a grouped aggregate of (address, least id), so a payload that a third
of all pages share is folded before anything moves. ``payloads`` is bucketed by address, so records are rebuilt without moving payloads
again; revisits have no body and meet no payload. ``export`` writes the records as ``.warc.gz`` files, ``read`` cuts them again by the
lengths that they state, and ``index`` takes all it says from those records: it recomputes each digest from the bytes read,
and a revisit finds size and digest at the response that it names. A difference ends the job.

A file holds at most ``records_per_file`` records and is one row of bytes while it is read, unpacked a piece at a time; packed, it must be
under 2 GB, the limit of a row.

Defined results: a null payload is empty; a null address of a page leaves the target header out, and control characters in it are
percent-encoded; rows that repeat an id and its payload are records of the same kind; a null id is never the
one that others refer to unless it is alone, and then it is a response; an empty table gives an empty archive.
Only the named columns are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import shared_dir, stage

END = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payload bytes of a bucket, bytes unpacked or handed on at a time, and targets of revisits that are broadcast.
BUCKET_BYTES, READ_BYTES, BROADCAST_ROWS = 128 << 20, 4 << 20, 1_000_000
#: Parts into which the revisits of one response are dealt where they are joined by a shuffle.
SALTS = 32
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 5 hexadecimal digits are 20 bits, and so 4 letters."""
    letters = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


@dataclass(frozen=True)
class Archive:
    """headers: page_id, address, header. payloads: address, payload."""

    headers: DataFrame
    payloads: DataFrame


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Store a record for each page. Of equal payloads of ``min_bytes`` or more, the page with the least id holds the response."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    first = rows.groupBy("address").agg(F.min("page_id").alias("first_id"))
    about = rows.select(
        "page_id", "address", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20").alias("uri"),
        F.octet_length("payload").alias("size"), base32(F.sha1("payload")).alias("digest"),
    ).join(first, "address")
    revisit = (F.col("size") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_name(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), "digest", F.lit(">")))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first_id")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
        F.lit(""), F.lit(""),
    ]
    headers = stage(about.select("page_id", "address", "size", F.concat_ws(END, *lines).alias("header")))
    return Archive(headers.drop("size"), _store(rows.select("address", "payload"), headers))


def _store(payloads: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each payload once, as a table in the shared folder, bucketed by address."""
    spark = payloads.sparkSession
    size = sizes.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    name = f"payloads_{uuid.uuid4().hex}"
    once = payloads.repartition(buckets, "address").groupBy("address").agg(F.first("payload").alias("payload"))
    once.write.bucketBy(buckets, "address").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def records(archive: Archive) -> DataFrame:
    """page_id and the bytes of each original record: header, then the payload of a response, then the record's end."""
    head = archive.headers.select("page_id", "address", F.encode("header", "utf-8").alias("head"), (_field("WARC-Type") == "response").alias("whole"))
    responses = head.where("whole").join(archive.payloads.hint("merge"), "address").select("page_id", "head", "payload")
    revisits = head.where("NOT whole").select("page_id", "head", F.lit(b"").alias("payload"))
    return responses.union(revisits).select("page_id", F.concat("head", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def export(archive: Archive, path: str, records_per_file: int = 10_000) -> None:
    """Write ``.warc.gz`` files: records one after another, their bytes as they are; the writer sets each record's end."""
    value = F.expr("substring(record, 1, octet_length(record) - 4)").cast("string").alias("value")
    records(archive).select(value).write.options(lineSep=END * 2, compression="gzip", maxRecordsPerFile=records_per_file).text(path)


def _cut(parts: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """Header and body of each record in a run of bytes."""
    held = bytearray()

    def more(wanted: int) -> bool:
        while len(held) < wanted:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while more(1):
        seen = 0
        while (stop := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more(seen + 1):
                raise ValueError("a record's header has no end")
        header = held[: stop + 4].decode("utf-8")
        length = next(int(x[16:]) for x in header.split(END) if x.startswith("Content-Length: "))
        after = stop + 4 + length
        if not more(after + 4) or held[after : after + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield header, bytes(held[stop + 4 : after])
        del held[: after + 4]


def _unpacked(content: bytes) -> Iterator[bytes]:
    packed = zlib.decompressobj(wbits=31)
    while content and not packed.eof:
        yield packed.decompress(content, READ_BYTES)
        content = packed.unconsumed_tail


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc.gz`` files: header text and body bytes, cut by the length that each header states."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                headers, bodies, size = [], [], 0
                for header, body in _cut(_unpacked(content.as_py())):
                    headers.append(header)
                    bodies.append(body)
                    size += len(header) + len(body)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(bodies, pa.binary())], names=["header", "body"])
                        headers, bodies, size = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(bodies, pa.binary())], names=["header", "body"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, "header string, body binary")


def index(read_back: DataFrame) -> DataFrame:
    """One row per record that was read, checked against its bytes: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    page = r"<urn:page:(-?[0-9]+)>"
    said = stage(read_back.select(
        F.regexp_extract("header", rf"\r\nWARC-Record-ID: {page}", 1).try_cast("bigint").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract("header", rf"\r\nWARC-Refers-To: {page}", 1).try_cast("bigint").alias("refers_to"),
        F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("said"),
        F.octet_length("body").cast("bigint").alias("size"), base32(F.sha1("body")).alias("digest"),
    ))
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest: "), "said"))
    responses = said.where("record_type = 'response'")
    own = responses.select("page_id", F.when(F.col("said") == F.col("digest"), F.col("size")).otherwise(wrong).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    revisits = said.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "said")
    named = revisits.select("refers_to", "said").distinct()
    targets = stage(
        responses.join(named.withColumnsRenamed({"refers_to": "page_id"}), ["page_id", "said"], "left_semi")
        .groupBy(F.col("page_id").alias("refers_to"), "said").agg(F.max("size").alias("payload_bytes"), F.max("digest").alias("payload_digest"))
    )
    if targets.count() <= BROADCAST_ROWS:
        found = revisits.join(F.broadcast(targets), ["refers_to", "said"], "left")
    else:
        dealt = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        found = dealt.join(targets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))), ["refers_to", "said", "salt"], "left")
    right = F.coalesce(F.col("said") == F.col("payload_digest"), F.lit(False))
    return own.union(found.select("page_id", F.when(right, F.col("payload_bytes")).otherwise(wrong), "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages (see :func:`write`), export the archives to the shared folder, read them back and index what was read."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    export(write(pages, **options), path)
    return index(read(spark, path))
