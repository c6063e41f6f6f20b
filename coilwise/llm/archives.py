"""Legacy archive converter: ARC records to WARC records, and back out of the files.

An ARC file starts with a version block whose second line names the version; every record is a header
line of fields split by blanks, the declared number of bytes, and a line end. Version 1 lines have url,
address, date, type, length; version 2 lines add result code, checksum, location, offset and file name. The converter reads
the fields that its version has, takes the declared length of bytes, and synthesises what WARC asks for:
a record id derived from the content, the date in ISO form, record type, block and payload digests.

Records with equal payloads are written once as a response; the others become revisits that refer to it.
Files are written by Spark's text writer, which puts the two line ends behind each record, with gzip, so
any store will do.

Defined cases: a null payload is an empty one; a null url is written as ``urn:none``; blanks in urls are
percent-encoded; rows that share page_id and payload are one response and revisits to it; a null page_id
comes after all others; an empty table writes no record; further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import in_buckets, new_folder, slices

CAPTURED = "20240101000000"
FILE_BYTES = 64 << 20
FIELDS = {1: ("url", "address", "date", "type", "length"), 2: ("url", "address", "date", "type", "code", "checksum", "location", "offset", "file", "length")}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NAMES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def sha1_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_bytes(version: int, url: str | None, payload: bytes, date: str = CAPTURED) -> bytes:
    """An ARC file of one record, of the given version."""
    body = HTTP + payload
    place = (url or "urn:none").replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A").encode()
    own = {"url": place, "address": b"0.0.0.0", "date": date.encode(), "type": b"text/html", "length": str(len(body)).encode(), "code": b"200", "checksum": b"-", "location": b"-", "offset": b"0", "file": b"legacy.arc"}
    about = f"{version} 0 coilwise\n".encode() + NAMES[version] + b"\n"
    head = b"filedesc://legacy.arc 0.0.0.0 " + date.encode() + b" text/plain " + (b"200 - - 0 legacy.arc " if version == 2 else b"") + str(len(about)).encode() + b"\n"
    return head + about + b"\n" + b" ".join(own[f] for f in FIELDS[version]) + b"\n" + body + b"\n"


def parse_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block, by declared lengths."""
    at, version = 0, None
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        end = raw.index(b"\n", at)
        values = raw[at:end].decode("utf-8", "replace").split(" ")
        body = raw[end + 1 : end + 1 + int(values[-1])]
        if len(body) < int(values[-1]):
            raise ValueError("an ARC record ends before its declared length")
        if version is None:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
        else:
            if len(values) != len(FIELDS[version]):
                raise ValueError("an ARC header line has not the fields of its version")
            yield dict(zip(FIELDS[version], values, strict=True)), body
        at = end + 1 + int(values[-1])


def payload_of(body: bytes) -> bytes:
    """What follows the HTTP header; all of it where there is none."""
    return body.partition(b"\r\n\r\n")[2] if body.startswith(b"HTTP/") else body


def record_id(name: str, digest: str) -> str:
    """Identifier of the record called ``name`` (page and number) with that payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {digest}')}>"


def warc_head(fields: dict[str, str], body: bytes, name: str, page: int | None, first: int | None, revisit: bool, first_name: str) -> bytes:
    """Header and block of the WARC record, without the two line ends behind it."""
    digest, payload = sha1_name(payload_of(body)), payload_of(body)
    d = fields["date"]
    block = b"" if revisit else body
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(name, digest)}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", f"WARC-Target-URI: {fields['url']}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_name(block)}",
        f"X-Page-Id: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(first_name, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {'' if first is None else first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block = raw[end + 4 : end + 4 + n]
        if not lines[0].startswith("WARC/") or len(block) < n or raw[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("not a WARC record of its declared length")
        yield fields, block
        at = end + 8 + n


def as_arc(pages: DataFrame) -> DataFrame:
    """(page_id, arc): each page as an ARC file of one record, even and odd page ids in versions 1 and 2."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            ids, urls, html = (b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html"))
            arc = [arc_bytes(1 + (p or 0) % 2, u, (h or "").encode()) for p, u, h in zip(ids.to_pylist(), urls.to_pylist(), html.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(arc, pa.binary())], ["page_id", "arc"])

    return pages.select("page_id", "url", "html").mapInArrow(make, "page_id bigint, arc binary")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, fields, body, digest, bytes) of every record of (page_id, arc)."""
    for b in slices(batches, "arc"):
        rows = []
        for page, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for fields, body in parse_arc(raw):
                payload = payload_of(body)
                rows.append((page, list(fields.items()), body, sha1_name(payload), len(payload)))
        kinds = (pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["page_id", "fields", "body", "digest", "bytes"])


def convert_archives(arcs: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the WARC files of ``arcs`` (page_id, arc) to ``folder``, of about ``file_bytes`` of payload each.

    Archives are parsed once; their records get numbers and are stored in buckets of those, so payloads stay
    where they are. Payloads of ``least`` bytes and more that are equal are written once: of each digest, the
    record with the smallest page_id and then the smallest number is the response, which partial sums
    find. What is decided about a record meets it by its number, so neither a payload nor a page_id that
    many records share gathers them in one task, and no task has to see them together.
    """
    kept = in_buckets(arcs.mapInArrow(_records, "page_id bigint, fields map<string,string>, body binary, digest string, bytes bigint").withColumn("row", F.monotonically_increasing_id()), "row", "records")
    keys = kept.select("row", "page_id", "digest", "bytes")
    firsts = keys.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"))
    decided = keys.join(firsts, ["digest", "bytes"], "left").select("row", F.col("first.page_id").alias("first"), F.col("first.row").alias("first_row"))
    total, many = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    rows = kept.join(decided, "row").select("page_id", "fields", "body", "row", "first", "first_row")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            page, fields, body, row, first, first_row = (c.to_pylist() for c in b.columns)
            out = [
                warc_head(dict(f), x, f"{p} {r}", p, first_page, fr is not None and fr != r, f"{first_page} {fr}")
                for p, f, x, r, first_page, fr in zip(page, fields, body, row, first, first_row, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.mapInArrow(convert, "record binary").select(F.col("record").cast("string").alias("value"))
    most = max(1, file_bytes * many // max(total, 1))
    records.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Page, sizes, digest, type and reference of every record in the files; a file is read as a whole."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = []
                for f, block in parse_warc(gzip.decompress(raw)):
                    kind = f["WARC-Type"]
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and sha1_name(payload_of(block)) != digest:
                        raise ValueError("a payload has not the digest of its header")
                    rows.append((int(f["X-Page-Id"]) if f["X-Page-Id"] else None, int(f["X-Payload-Length"]), digest, kind, int(f["X-Refers-To-Page"]) if f.get("X-Refers-To-Page") else None))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select("content").mapInArrow(parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


@llm_query("op10_archive_converter")
def op10_archive_converter(spark, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC, as read back from the archives."""
    folder = new_folder(spark, "warc")
    convert_archives(as_arc(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    return read_warc(spark, folder)
