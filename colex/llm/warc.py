"""WARC archives with revisit resolution.

Headers (digest, bytes and id) are written once, and only they are shuffled by payload digest; the payloads move once, by
page, to their decision and into the archives.  Of the records with one payload the first by
page_id is the response, the others become revisit records that point to it.

Archives are written by Spark's own committed file writer: a row is one record and the
line separator is the blank line that ends a WARC record, so a lost executor leaves no
half-written archive and any store that Spark can write to will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, scratch, table

#: Payloads below this many bytes are always stored: a revisit record would be as long.
LEAST_REVISIT = 100
#: Records in one archive at most, if their payloads have at most so many bytes (in all 128 MB, so
#: that a reader's task holds a bounded file); payloads up to 8 times as long go into archives of
#: their own of an eighth of the records, and so on, down to one record.
RECORDS_PER_FILE, RECORD_BYTES, STEP = 2_000, 64_000, 8
#: Pages with shared payloads (about 100 bytes each) up to which their table is broadcast.
BROADCAST_ROWS = 200_000
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
END = CRLF + CRLF


def _digested(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        "url",
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(F.encode(html, "utf-8"), 256).alias("payload_digest"),
    )


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of every page: all that resolution needs of it."""
    return _digested(pages).select("page_id", "payload_bytes", "payload_digest")


def resolve(heads: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, payload_digest, first_id, times for every page of headers() whose payload another record has too.

    first_id is the smallest page_id with the payload, null ids last.  Only headers are
    shuffled; the groups are counted and their first id found before the shuffle, so a
    payload that a third of all pages share is a few rows, and payloads that occur once,
    which are most, are dropped there.
    """
    heads = heads.where(F.col("payload_bytes") >= least)
    groups = heads.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1")
    times = heads.groupBy("page_id", "payload_digest").agg(F.count(F.lit(1)).alias("times"))
    return times.join(groups.drop("n"), "payload_digest")


def _record_id(page_id: Column, digest: Column, nth: Column) -> Column:
    """A fresh urn:uuid from page, digest and repeat, the same on every rerun."""
    h = F.md5(F.concat_ws(":", F.lit("record"), F.coalesce(page_id.cast("string"), F.lit("")), digest, nth.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\r\n]+", " ")


def size_class(payload_bytes: Column) -> Column:
    """0 for payloads of RECORD_BYTES or less, 1 up to STEP times as long, ..; the last one has no greatest length."""
    last = math.ceil(math.log(RECORDS_PER_FILE, STEP))
    return sum((F.when(payload_bytes > RECORD_BYTES * STEP**i, 1).otherwise(0) for i in range(last)), F.lit(0))


def records(pages: DataFrame, found: DataFrame) -> DataFrame:
    """A string column `value`, each page's WARC record up to the blank line that ends it, and
    `size_class`; `found` is the written result of resolve().

    Only pages with a shared payload have anything to look up.  While those are few (checked
    by count) their table is broadcast and payloads go from the scan into the archives;
    beyond that payloads travel once, keyed by page and digest, which no hot payload makes
    uneven.  Of repeated rows (one page_id and payload) one is taken for the first.
    """
    found = found.withColumnsRenamed({"page_id": "id", "payload_digest": "digest"})
    whole = _digested(pages)
    same = whole["page_id"].eqNullSafe(found["id"]) & (whole["payload_digest"] == found["digest"])
    joined = whole.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, same, "left")
    repeated = F.col("times") > 1
    nth = F.row_number().over(W.partitionBy("page_id", "payload_digest").orderBy("url"))
    single = joined.where(~F.coalesce(repeated, F.lit(False))).withColumn("nth", F.lit(1))
    joined = single.unionByName(joined.where(repeated).withColumn("nth", nth)) if found.where(repeated).head(1) else single
    joined = joined.withColumn("revisit", F.col("digest").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("nth") > 1)))
    joined = joined.withColumn("refers_to", F.when(F.col("revisit"), F.col("first_id")))
    http = F.when(F.col("revisit"), F.lit("HTTP/1.1 200 OK" + END)).otherwise(
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.col("payload_bytes").cast("string"),
            F.lit(END),
        )
    )
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"), F.col("nth"))),
        line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(
            F.col("revisit"),
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest"), F.lit(1))),
                line("X-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))),
            ),
        ).otherwise(F.lit("")),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    value = F.concat(head, http, F.when(F.col("revisit"), "").otherwise(F.col("html")))
    return joined.select(value.alias("value"), size_class(F.col("payload_bytes")).alias("size_class"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, per_file: int = RECORDS_PER_FILE) -> None:
    """Write deduplicated, compressed archives of all pages into folders of `path`, one per size class.

    Null html is an empty payload; an empty table writes an empty folder.  Payloads of any length are
    records, long ones in archives of few.  Of repeated rows one is the response.  Columns other than
    page_id, url and html are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    heads = materialise(headers(pages), "warc-headers")
    found = materialise(resolve(heads, least), "warc-resolved")
    out = records(pages, found)
    sizes = heads.select(size_class(F.col("payload_bytes")).alias("c")).distinct()
    for c in sorted(r["c"] for r in sizes.collect()) or [0]:
        some = out.where(F.col("size_class") == c).select("value")
        some.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file // STEP**c)).text(f"{path}/{c}")
    discard(found, heads)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, gzip-compressed or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive))
    while version := stream.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {version[:40]!r}")
        head: dict[str, str] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the archive ends within a record")
        yield head, block


READ_SCHEMA = (
    "page_id long, url string, record_type string, record_id string, refers_record string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; a response's payload is held against its digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        number = lambda text: int(text) if text else None
        for files in batches:
            for content in files.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
                    size = int(head["x-payload-bytes"])
                    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
                    rows.append(
                        (
                            number(head["x-page"]), head["warc-target-uri"], head["warc-type"], head["warc-record-id"],
                            head.get("warc-refers-to"), number(head.get("x-refers-to-page")), size, digest, payload if payloads else None,
                        )
                    )
                    if len(rows) >= 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(work, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive record for every page, reads the archives back, and reports them.

    Null html is an empty payload.  Payloads below LEAST_REVISIT bytes are always responses.
    """
    path = scratch(spark, "warc-archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             row_number() OVER (PARTITION BY sha256(h) ORDER BY page_id NULLS LAST) AS nth,
             first_value(page_id) OVER (PARTITION BY sha256(h) ORDER BY page_id NULLS LAST) AS first_id
      FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first_id END AS refers_to
FROM q
"""
