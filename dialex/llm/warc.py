"""Web archives: a converter from the legacy ARC format to WARC, a WARC writer through Spark, and a reader.

ARC files come in two versions, told by the second line of their first record: version 1 gives a record five header
fields, version 2 ten. The converter reads that line, takes every record by its declared length, and synthesises what
WARC wants besides: record ids, timestamps, types and digests. Records whose payload was seen before become revisits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.common import base32_sha1, bound_arrow, materialise, new_path, table

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes below which a page is of a class, and the records that a WARC file of that class holds at most: a file
#: has some 250 MB before compression, or one larger page.
FILE_CLASSES = ((1 << 16, 4000), (1 << 20, 250), (1 << 24, 16), (1 << 62, 1))


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    status: str = "-"
    version: int = 1


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """What an HTTP message carries, or the block itself."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("Content-Type", "").startswith("application/http") else self.block

    def http_header(self, name: str) -> str | None:
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == name.lower().encode():
                return value.strip().decode()
        return None


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[ArcRecord], version: int, name: str = "records.arc", date: str = "19960101000000") -> bytes:
    """An ARC file: the version block, then each record's header line, body and a newline."""
    block = f"{version} 0 dialex\n{ARC_FIELDS[version]}\n\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(block)}\n".encode(), block]
    for r in records:
        more = f"{r.status} - - 0 {name} " if version == 2 else ""
        out += [f"{r.url} {r.ip} {r.date} {r.mime} {more}{len(r.body)}\n".encode(), r.body, b"\n"]
    return b"".join(out)


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block. Header lines are split from the right, as URLs may hold
    spaces; a record that ends before its declared length is an error."""
    version = 0
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if not version:
            if not text.startswith("filedesc://"):
                raise ValueError(f"not an ARC file: {text[:60]!r}")
            block = stream.read(int(text.rsplit(" ", 1)[1]))
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        parts = text.rsplit(" ", 4 if version == 1 else 9)
        if len(parts) != len(ARC_FIELDS[version].split()):
            raise ValueError(f"bad ARC header line: {text[:120]!r}")
        body = stream.read(length := int(parts[-1]))
        if len(body) != length:
            raise ValueError(f"{parts[0]}: {len(body)} of {length} bytes")
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], body, parts[4] if version == 2 else "-", version)


def record_urn(key: str) -> str:
    """The id made up for a record: the same key, the same id, so that a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def warc_date(arc: str) -> str:
    """A WARC timestamp from an ARC date of 8 to 14 digits; missing digits are the earliest."""
    d = arc + "00000101000000"[len(arc) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(arc: ArcRecord, key: str | None = None, refers_to: str | None = None) -> WarcRecord:
    """The WARC record of an ARC record: a response if it holds an HTTP message, else a resource. With `refers_to`, the
    key of another record, it becomes a revisit of that one, which keeps the HTTP head and drops the payload."""
    http = arc.body.startswith(b"HTTP/")
    head, gap, payload = arc.body.partition(b"\r\n\r\n") if http else (b"", b"", arc.body)
    digest = sha1_base32(payload)
    key = key or f"{arc.url} {arc.date} {digest}"
    block = head + gap if refers_to and http else b"" if refers_to else arc.body
    headers = {"WARC-Type": "revisit" if refers_to else "response" if http else "resource", "WARC-Record-ID": record_urn(key), "WARC-Date": warc_date(arc.date), "WARC-Target-URI": arc.url, "WARC-IP-Address": arc.ip}
    if refers_to:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_urn(refers_to)}
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": "application/http; msgtype=response" if http else arc.mime, "Content-Length": str(len(block))}
    return WarcRecord(headers, block)


def warc_bytes(record: WarcRecord) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in record.headers.items())
    return f"{WARC_VERSION}\r\n{head}\r\n".encode("utf-8", "surrogateescape") + record.block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    """The records of an uncompressed WARC stream, taken by declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[key.strip()] = value.strip()
        block = stream.read(length := int(headers["Content-Length"]))
        if len(block) != length:
            raise ValueError(f"{headers.get('WARC-Record-ID')}: {len(block)} of {length} bytes")
        yield WarcRecord(headers, block)


def _key(page_id: int | None, nth: int, url: str | None) -> str:
    return f"row {nth} {page_id} {url}"


def _to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, payload, nth, first) to the text of their WARC records, by way of ARC files of both versions.
    A record's key is its place in the table, its id and its URL, so no two records share one; first is the place, id
    and URL of the page that a revisit refers to."""
    for batch in batches:
        rows = batch.to_pylist()
        for version in ARC_FIELDS:
            part = [r for i, r in enumerate(rows) if i % 2 == version - 1]
            arcs = []
            for r in part:
                payload = r["payload"]
                row = "" if r["page_id"] is None else f"X-Row: {r['page_id']}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{row}\r\n".encode()
                url = "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in r["url"] or "urn:no-url")
                arcs.append(ArcRecord(url, "0.0.0.0", "20240101000000", "text/html", head + payload, "200"))
            out = []
            for r, arc in zip(part, read_arc(io.BytesIO(write_arc(arcs, version))), strict=True):
                first = r["first"] and _key(**r["first"])
                out.append(warc_bytes(convert(arc, _key(r["page_id"], r["nth"], r["url"]), first))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            stream = io.BytesIO(content)
            for r in read_warc(gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream):
                digest, kind = r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.headers["WARC-Type"]
                if kind == "response" and sha1_base32(r.payload) != digest:
                    raise ValueError(f"{r.headers['WARC-Record-ID']}: payload doesn't match its digest")
                row = r.http_header("X-Row")
                size = len(r.payload) if kind == "response" else int(r.http_header("Content-Length"))
                rows.append((row and int(row), size, digest, kind, r.headers.get("WARC-Refers-To"), r.headers["WARC-Record-ID"], r.headers["WARC-Target-URI"]))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_id", "record_id", "target_uri"]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes gzipped WARC files with a record per row of pages(page_id, url, html).

    Among equal payloads of at least `min_revisit_bytes` the row with the smallest page_id is the response and the
    others revisit it. A null html is empty, a null url is urn:no-url; rows with a null page_id are written without a
    row number and never are what others revisit unless all of a payload's rows have none; rows equal in page_id and
    payload are responses each, with ids of their own. An empty table gives no record. Record ids hold a row's place, so
    pages should be a stored table. Spark's text writer puts the files where any Hadoop file system is, one folder a
    class of sizes: a record ends in CR LF CR LF, of which the last byte is the writer's line separator.
    """
    bound_arrow(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    size = F.length("payload")
    kind = F.lit(None)
    for i, (below, _) in reversed(list(enumerate(FILE_CLASSES))):
        kind = F.when(size < below, i).otherwise(kind)
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "nth": F.monotonically_increasing_id(), "kind": kind})
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "nth", "url")))
    groups = rows.where(size >= min_revisit_bytes).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(groups, "digest", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first.page_id")), F.col("first")))
    for (i,) in sorted(rows.select("kind").distinct().collect()) or [(0,)]:  # as many as there are classes
        text = marked.where(F.col("kind") == i).select("page_id", "url", "payload", "nth", "first").mapInArrow(_to_records, "value binary").select(F.col("value").cast("string"))
        text.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", FILE_CLASSES[i][1]).text(f"{path}/class-{i}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri) of the WARC files under
    `path`. The digest of every response is checked against its payload, files are read record by record, and refers_to
    is the row of the record that a revisit names."""
    bound_arrow(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string, record_id string, target_uri string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = materialise(files.select("content").mapInArrow(_from_files, schema), "records")
    named = found.where("refers_id IS NOT NULL").select(F.col("refers_id").alias("id")).distinct()  # a page that many revisit is one row
    rows = found.select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to")).join(named, "id", "left_semi")
    out = found.join(rows, found.refers_id == rows.id, "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written as archives and read back; what nulls and repeated rows mean is said at
    `write_pages`, and an empty table gives no row."""
    path = new_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_warc_round_trip": op2_warc_round_trip}
_B32 = " || ".join(f"translate(to_base(CAST('0x' || substr(h, {i}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in (1, 11, 21, 31))
ORACLES: dict[str, str] = {
    "op2_warc_round_trip": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
}
