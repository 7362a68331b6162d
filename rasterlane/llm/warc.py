"""WARC: conversion of legacy ARC archives, writing and reading.

An ARC file starts with a version block that declares the fields of every later header line: version 1 (url, address, date,
type, length) or 2 (with result code, checksum, location, offset and file name as well). A record is a header line, as many bytes
as its last field declares, and a line end. Conversion parses these and synthesises what WARC asks for: a record identifier made
from the page and the digest, an ISO timestamp, the record's type and base32 SHA-1 digests of block and payload.

Of records with equal payloads (of `min_bytes` at least) that with the largest page id is written as a response, the others as
revisits of it, without payload. Which records are revisits is found on narrow rows: digests that recur are summed, and joined to
the pages' narrow rows, where Spark's skew handling splits a hot digest. Payloads travel once, by page and digest, so that
a group of copies is spread over all tasks. Records are written through Spark's text writer, gzipped, in files of `file_bytes` at
the records' mean size and of `file_records` records at most. Pages become ARC and then records in one Python function; tasks work
on 2 MB of payload at a time. Reading streams each file once, by declared lengths.

Defined cases: null html is an empty payload; null url is written as `urn:page:`; a null page id cannot name a record and is
kept as the empty id; repeated rows of the largest page id are all responses; several revisits are all kept; an empty table writes
no records and reads none; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, drop_path, new_path, table, utf8_list, written

#: Fixed values of the two formats: the fields of an ARC header line by version, and the end of a WARC record.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = b"\r\n\r\n"
RECORD = "page_id string, uri string, date string, kind string, payload binary, digest string, n long"
CHUNK = 1 << 20
MOST_BYTES = 2_000_000  # of payload at once in a task
ARC_BYTES = 64_000  # of payload in one ARC part


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC ---


def arc_version_block(version: int, name: str = "pages.arc", date: str = "20200101000000") -> bytes:
    body = f"{version} 0 rasterlane\n{ARC_FIELDS[version]}\n".encode()
    rest = {1: "0.0.0.0 {d} text/plain {n}", 2: "0.0.0.0 {d} text/plain 200 - - 0 {f} {n}"}[version]
    return f"filedesc://{name} {rest.format(d=date, n=len(body), f=name)}\n".encode() + body + b"\n"


def arc_record(version: int, page_id: str, url: str, payload: bytes, date: str = "20200101000000") -> bytes:
    """A page as an ARC record: the document is the HTTP response, whose headers carry the page's id."""
    http = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    uri = quote(url or "urn:page:", safe="%/:=&?~#+!$,;'@()*[]-._")
    middle = f"0.0.0.0 {date} text/html" + (f" 200 {sha1_base32(http)} - 0 pages.arc" if version == 2 else "")
    return f"{uri} {middle} {len(http)}\n".encode() + http + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file's bytes, its version block left out."""
    at, fields = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        n = int(line.rsplit(" ", 1)[1])
        body = data[end + 1 : end + 1 + n]
        if len(body) != n:
            raise ValueError(f"the record of {line!r} ends early")
        at = end + 1 + n
        if line.startswith("filedesc://"):
            version = int(body.split(None, 1)[0])
            fields = body.split(b"\n")[1].decode().split(" ")
            if fields != ARC_FIELDS.get(version, "").split(" "):
                raise ValueError(f"unknown fields of ARC version {version}")
            continue
        if fields is None:
            raise ValueError("an ARC file starts with its version block")
        # blanks inside the url are an old writers' fault: the other fields are counted from the right
        values = line.rsplit(" ", len(fields) - 1)
        head, gap, payload = body.partition(b"\r\n\r\n")
        headers = dict(h.split(b": ", 1) for h in head.split(b"\r\n")[1:] if b": " in h) if gap else {}
        yield dict(zip(fields, values)) | {"page_id": headers.get(b"X-Page-Id", b"").decode(), "head": head + gap, "payload": payload if gap else body}


def convert(arc: dict) -> dict:
    """What a WARC record says, from an ARC one."""
    d = arc["Archive-date"].ljust(14, "0")
    return {"page_id": arc["page_id"], "uri": arc["URL"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
            "kind": arc["Content-type"], "payload": arc["payload"], "digest": sha1_base32(arc["payload"]), "n": len(arc["payload"])}


_RECORD_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _records(content: bytes) -> pa.RecordBatch:
    rows = [convert(x) for x in parse_arc(content)]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], {"payload": pa.binary(), "n": pa.int64()}.get(n, pa.string())) for n in _RECORD_NAMES], _RECORD_NAMES)


def read_arc(arcs: DataFrame) -> DataFrame:
    """arcs: a column `content` with the bytes of an ARC file or part, each with its version block (a binaryFile scan has it).
    A row per record, RECORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _records(_unpacked(content.as_py() or b""))

    return arcs.select("content").mapInArrow(run, RECORD)


def _unpacked(content: bytes) -> bytes:
    return zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content


def _page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(url_col), F.lit("")).alias("u"), F.coalesce(F.col(html_col), F.lit("")).alias("h"))


def _arc_parts(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[bytes]:
    """ARC parts of about part_bytes of payload, versions 1 and 2 by turns."""
    version = 1
    for batch in (part for whole in batches for part in blocks(whole, "h", part_bytes)):
        parts = [arc_version_block(version)]
        for i, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_list(batch.column(2))):
            parts.append(arc_record(version, i, url, html))
        yield b"".join(parts)
        version = 3 - version


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_bytes: int = ARC_BYTES) -> DataFrame:
    """Pages as small ARC files in a column `content`, versions 1 and 2 by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _arc_parts(batches, part_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    return _page_rows(pages, id_col, url_col, html_col).mapInArrow(run, "content binary")


def pages_through_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part_bytes: int = ARC_BYTES) -> DataFrame:
    """read_arc(pages_to_arc(pages)) in one Python function, so that a task needs one Python worker: a row per page, RECORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in _arc_parts(batches, part_bytes):
            yield _records(content)

    return _page_rows(pages, id_col, url_col, html_col).mapInArrow(run, RECORD)


# --- WARC ---


def record_id(page_id: str, digest: str) -> str:
    """A stable version 8 UUID: 120 bits of a hash over the page's id and the digest."""
    h = hashlib.sha256(f"{page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def warc_record(r: dict) -> bytes:
    """Header and block, without the end that follows every record. r: RECORD's names and refers_to, the page id of the
    response that a revisit stands for."""
    page, first = r["page_id"], r["refers_to"]
    http = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
    block = http + (b"" if first is not None else r["payload"])
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, r['digest'])}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}",
            f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Page-ID: {page}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, r['digest'])}",
                 f"WARC-Refers-To-Page-ID: {first}", f"WARC-Payload-Length: {r['n']}", "WARC-Truncated: length"]
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block


def write_warc(records: DataFrame, path: str, min_bytes: int = 0, file_records: int = 4000, file_bytes: int = 64_000_000) -> None:
    """records: RECORD. Writes gzipped WARC files into the folder `path`, of file_records records at most and of about file_bytes
    of payload. The records are evaluated twice, once for their narrow columns alone."""
    spark = records.sparkSession
    bound_batches(spark)
    narrow, held = written(records.select("page_id", "digest", "n"), "digests")
    size = F.when(F.col("page_id") == "", None).otherwise(F.col("page_id").try_cast("long"))
    again = narrow.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max(F.struct(size.alias("k"), "page_id")).alias("first"), F.count("*").alias("times"))
    again, counted = written(again.where("times > 1").select("digest", "n", F.col("first.page_id").alias("refers_to")), "recurring")
    # a row for each page and digest that is not its group's response
    later = narrow.join(again, ["digest", "n"]).where(F.col("refers_to") != F.col("page_id")).select("page_id", "digest", "refers_to").distinct()
    rows = records.join(later, ["page_id", "digest"], "left").select("page_id", "uri", "date", "payload", "digest", "n", "refers_to")
    mean = narrow.agg(F.avg("n").alias("n")).first().n or 0
    file_records = max(1, min(file_records, int(file_bytes / max(1, mean))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "payload", MOST_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in batch.to_pylist()], pa.binary())], ["value"])

    # the text writer puts a string's bytes as they are, and lineSep after each
    text = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", RECORD_END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)
    drop_path(spark, held)
    drop_path(spark, counted)


class _Stream:
    """Bytes of a gzip stream, unpacked as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer, self.gz = memoryview(data), 0, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.gz.eof and (rest := self.gz.unused_data):  # another member follows
            self.gz = zlib.decompressobj(31)
            self.buffer += self.gz.decompress(rest)
            return True
        if self.at >= len(self.data):
            return False
        self.buffer += self.gz.decompress(self.data[self.at : self.at + CHUNK])
        self.at += CHUNK
        return True

    def until(self, end: bytes) -> bytes:
        start = 0
        while (k := self.buffer.find(end, start)) < 0:
            start = max(0, len(self.buffer) - len(end))
            if not self._more():
                out, self.buffer = bytes(self.buffer), bytearray()
                return out
        return self.take(k + len(end))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped WARC file, by declared lengths."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")).strip():
        lines = head.decode("utf-8", "replace").rstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = stream.take(n := int(fields["Content-Length"]))
        if len(block) != n or stream.take(len(RECORD_END)) != RECORD_END:
            raise ValueError("a WARC record ends early")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the folder's files: page_id, uri, payload_bytes, payload_digest, record_type, refers_to and the payload
    as it stands in the record. A response's length and digest are those of the payload that was read."""
    schema = "page_id string, uri string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for fields, block in parse_warc(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    first = fields.get("WARC-Refers-To-Page-ID")
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and sha1_base32(payload) != told:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
                    rows.append((fields["WARC-Page-ID"], fields["WARC-Target-URI"], len(payload) if first is None else int(fields["WARC-Payload-Length"]), told, fields["WARC-Type"], first, payload))
                    size += len(payload)
                    if size > 4 * CHUNK:
                        yield _rows(rows, names)
                        rows, size = [], 0
                yield _rows(rows, names)

    return files.mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(pages_through_arc(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.col(c).try_cast("long").alias(c)
    return read_warc(spark, path).select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
