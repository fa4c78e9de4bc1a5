"""WARC archives and revisit resolution.

Archives are written by Spark's text writer: a row is a record (headers, empty line, block) and the line separator is
the two CRLFs that end a record, so files lie wherever Spark can write. A file holds FILE_BYTES of records at most, or
one longer record. They are read as binary files, unpacked as a stream and parsed by Content-Length. Resolution shuffles headers only, by payload digest, with map-side
partial aggregation; payloads meet their record's decision by a join on the unique record id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, bound_arrow, require

MIN_PAYLOAD = 100
#: Bytes of records, not compressed, that a file holds; a longer record is alone in its file.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, page_id long, uri string, warc_date string, payload_bytes long, payload_digest string, refers_to_id string"


def _header(name: str, value) -> F.Column:
    """A header line, left out if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _clean(c) -> F.Column:
    return F.regexp_replace(c, "[\\r\\n]+", " ")


def _http(payload) -> F.Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload)


def record(kind, page_id, uri, date, record_id, digest, block, refers_to=None, refers_uri=None, refers_date=None, captured=None) -> F.Column:
    """The text of a record up to its block's end; all arguments are columns. X-Page-Id and X-Captured (the date of the
    record that it was made from) are our extension fields."""
    null, revisit = F.lit(None).cast("string"), kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", kind), _header("WARC-Record-ID", record_id), _header("WARC-Date", date), _header("WARC-Target-URI", _clean(uri)),
        _header("X-Page-Id", page_id.cast("string")), _header("X-Captured", null if captured is None else captured), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _header("WARC-Refers-To", null if refers_to is None else refers_to),
        _header("WARC-Refers-To-Target-URI", null if refers_uri is None else _clean(refers_uri)), _header("WARC-Refers-To-Date", null if refers_date is None else refers_date),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def write_archive(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """records: one string column of records. Gzip files of file_bytes of records; a task numbers its files as it goes."""
    bound_arrow(records.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, 0
        for b in batches:
            files = []
            for n in pa.compute.binary_length(b.column(0)).to_pylist():
                if held and held + n > file_bytes:
                    at, held = at + 1, 0
                held += n
                files.append(at)
            yield pa.record_batch([b.column(0), pa.array(files, pa.int32())], ["value", "file"])

    numbered = records.toDF("value").mapInArrow(number, "value string, file int")
    numbered.write.partitionBy("file").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
        yield head, f.read(int(head["content-length"]))


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record: FIELDS and, if asked for, payload. Length and digest are of the payload that is in the record
    if there is one; a revisit has none, so its length is null and its digest is the one in its header."""
    bound_arrow(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payloads
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()][: len(names)]
        rows: list[tuple] = []
        size = 0
        flush = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            for content in b.column(0):
                for h, block in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    body = None if h["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                    digest = h["warc-payload-digest"].removeprefix("sha256:") if body is None else hashlib.sha256(body).hexdigest()
                    page = h.get("x-page-id")
                    row = (h["warc-record-id"], h["warc-type"], page and int(page), h.get("warc-target-uri"), h["warc-date"], None if body is None else len(body), digest, h.get("warc-refers-to"))
                    rows.append((*row, body and body.decode() or "") if payloads else row)
                    size += 300 + len(body or b"") * payloads
                    if size > 4 << 20:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, FIELDS + ", payload string" * payloads)


def _urn(name: F.Column) -> F.Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(name.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def pages_to_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a response record per row; a null payload is empty, other columns are ignored."""
    require(pages, id_col, url_col, html_col)
    run, html = uuid.uuid4().hex, F.coalesce(F.col(html_col), F.lit(""))
    urn = _urn(F.concat(F.lit(run), F.monotonically_increasing_id().cast("string")))
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), html.alias("h"), urn.alias("r"))
    write_archive(rows.select(record(F.lit("response"), F.col("i"), F.col("u"), F.lit(_now()), F.col("r"), F.sha2("h", 256), _http(F.col("h")))), path)


def resolve(heads: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """heads: FIELDS of responses. Returns a row per revisit: record_id, to_id, to_uri.

    Of records with equal payloads of min_payload bytes at least, the one with the smallest page_id (null last, then
    the smallest record id) stays a response.
    """
    order = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "record_id", "uri")
    slim = heads.filter(F.col("payload_bytes") >= min_payload)
    first = slim.groupBy("payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).filter("n > 1").select("payload_digest", "payload_bytes", "f")
    return slim.select("payload_digest", "payload_bytes", "record_id").join(first, ["payload_digest", "payload_bytes"]).filter("record_id <> f.record_id").select(
        "record_id", F.col("f.record_id").alias("to_id"), F.col("f.uri").alias("to_uri")
    )


def deduplicate_archive(spark: SparkSession, source: str, target: str, scratch: Scratch, min_payload: int = MIN_PAYLOAD) -> None:
    """Writes source's records to target with fresh headers; repeated payloads become revisit records.

    Records get new ids and dates; a revisit refers to its original's new ones. New ids follow from the old ones and
    this run, so neither side needs the other's row.
    """
    run, now = uuid.uuid4().hex, F.lit(_now())
    heads = scratch.table(read_archive(spark, source), "heads")
    revisits = scratch.table(resolve(heads, min_payload), "revisits")
    all_ = read_archive(spark, source, payloads=True).join(revisits.hint("merge"), "record_id", "left")
    is_revisit, c = F.col("to_id").isNotNull(), F.col
    kind = F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))
    block = F.when(is_revisit, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")).otherwise(_http(c("payload")))
    rows = all_.withColumns({"kind": kind, "block": block})
    fresh = lambda old: F.when(c(old).isNotNull(), _urn(F.concat(F.lit(run), c(old))))
    to_date = F.when(is_revisit, now)
    write_archive(rows.select(record(c("kind"), c("page_id"), c("uri"), now, fresh("record_id"), c("payload_digest"), c("block"), fresh("to_id"), c("to_uri"), to_date, c("warc_date"))), target)


def resolved(archive: DataFrame) -> DataFrame:
    """archive: what read_archive gives of a deduplicated archive. Joins revisits to their responses; a row per record:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    response = archive.filter("record_type = 'response'")
    original = response.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    revisit = archive.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", F.col("refers_to_id").alias("to"))
    # most revisits may refer to one response: distinct references find their response, then meet the revisits
    found = original.join(revisit.select("to").distinct(), "to", "left_semi")
    rows = revisit.join(found.hint("merge"), "to").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return response.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(rows)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages, resolves revisits, writes the deduplicated archive, reads it back: a row per page.

    Null html is an empty payload. Payloads under 100 bytes are always responses. Repeated rows: one of them is the
    response. A null page_id is largest. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    raw, slim = scratch.path("raw.warc"), scratch.path("dedup.warc")
    pages_to_archive(pages, raw, id_col, url_col, html_col)
    deduplicate_archive(spark, raw, slim, scratch)
    scratch.drop(raw)
    return resolved(scratch.table(read_archive(spark, slim), "read"))
