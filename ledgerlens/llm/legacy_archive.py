"""Legacy archive converter: ARC files of both versions in, WARC files out.

:func:`write_arc` writes pages as ARC archives, version 1 and version 2 in turn. :func:`convert` reads archives by
their declared lengths: the version block at the start of a file tells which fields a record's header line has
(version 1: URL, IP, date, type, length; version 2 adds result code, checksum, location, offset and file name).
Every record becomes a WARC record with a synthesised identifier, timestamp, type and digests. Of the records
with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest page_id is a response and the
others become revisits of it. :func:`read_warc` parses the written archives.

Archives are written as whole files of about ``ARCHIVE_BYTES`` by Spark's own committed writer and read as binary
files, on any file system. Only (digest, page_id, place) rows are grouped by payload, pre-aggregated per task;
the payloads stay in their archives. A revisit notice goes back to its archive, whose records bound the list.

Defined cases: null html is an empty payload; a null url is written as ``-`` and read back as null, white space
in a url is percent-encoded and the urls ``-`` and "" get the prefix ``about:``; a null page_id stays null and is always a response; rows that
repeat the smallest page_id of a payload are responses too; an empty table gives an empty result; very long pages
make an archive of their own; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unique_dir
from . import common as C

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
#: The pages carry no capture time; the first page's is this, each page_id adds one second.
FIRST_CAPTURE = datetime(2008, 1, 1)

# Fixed values of the two ARC versions and of WARC.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
          "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _safe(url: str | None) -> str:
    if url is None:
        return "-"
    return re.sub("[\0- \x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url not in ("", "-") else f"about:{url}"


def _capture(page_id: int | None) -> datetime:
    return FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % (1 << 30))


def arc_record(page_id: int | None, url: str | None, payload: bytes, version: str, archive: str, offset: int) -> bytes:
    """Header line of the version, then the HTTP response; its length is declared in the last field."""
    named = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = {"URL": _safe(url), "IP-address": "0.0.0.0", "Archive-date": _capture(page_id).strftime("%Y%m%d%H%M%S"),
              "Content-type": "text/html", "Archive-length": str(len(block)), "Result-code": "200",
              "Checksum": hashlib.sha1(payload).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": archive}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


def arc_start(version: str, archive: str) -> bytes:
    """The version block that opens a file; itself a record whose length is declared."""
    body = f"{version} 0 converter\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{archive}", "IP-address": "0.0.0.0", "Archive-date": FIRST_CAPTURE.strftime("%Y%m%d%H%M%S"),
              "Content-type": "text/plain", "Archive-length": str(len(body)), "Result-code": "200", "Checksum": "-", "Location": "-",
              "Offset": "0", "Filename": archive}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes, bytes]]:
    """(place, header fields, HTTP headers, HTTP head, payload) of every record of an archive."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # separators between records
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode().split(" ")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} is cut off")
        if names is None:
            version = block.split(b" ", 1)[0].decode()
            if not parts[0].startswith("filedesc://") or version not in ARC_FIELDS:
                raise ValueError("no version block")
            names = ARC_FIELDS[version]
        else:
            if len(parts) != len(names):
                raise ValueError(f"header line at {at} has {len(parts)} fields")
            cut = block.index(b"\r\n\r\n") + 4
            yield at, dict(zip(names, parts, strict=True)), http_headers(block[:cut]), block[:cut], block[cut:]
        at = end + 1 + length


def http_headers(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:]) if k}


def record_id(page_id: str | None, url: str, date: str, digest: str, place: str) -> str:
    """The same record always gets the same identifier; ``place`` tells records without a page_id apart."""
    name = "\n".join([page_id if page_id is not None else f"at {place}", url, date, digest])
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)}>"


def warc_record(fields: dict[str, str], http: dict[str, str], head: bytes, payload: bytes, place: str, original: dict | None) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    date = datetime.strptime(fields["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    page = http.get("x-page-id")
    block = head if original else head + payload
    headers = [("WARC-Type", "revisit" if original else "response"), ("WARC-Record-ID", record_id(page, fields["URL"], date, digest, place)),
               ("WARC-Date", date), ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if original:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original["id"]), ("WARC-Refers-To-Target-URI", original["url"]),
                    ("WARC-Refers-To-Date", original["date"])]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, by the declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:] if x)
        length = int(headers["Content-Length"])
        yield headers, data[end : end + length]
        at = end + length


def _as_batch(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.large_binary()).cast(pa.binary())], names=["value"])


def _write(archives: DataFrame, path: str) -> None:
    """One file an archive; a string column may hold any bytes and the text writer puts them out as they are."""
    (archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def write_arc(pages: DataFrame, path: str) -> None:
    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, size = 0, [], 0
        for batch in batches:
            for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), C.text_bytes(batch.column("html")), strict=True):
                if not held:
                    version, name, count = str(1 + count % 2), f"pages-{count:06d}.arc", count + 1
                    held, size = [start := arc_start(version, name)], len(start)
                held.append(arc_record(page, url, html, version, name, size))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _as_batch(b"".join(held))
                    held = []
        if held:
            yield _as_batch(b"".join(held))

    _write(pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(archives, "value binary"), path)


_PLACES = "path string, at bigint, page_id bigint, url string, date string, digest string, n_bytes bigint"


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the ARC archives below ``path``, without its payload."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(name, at, int(http["x-page-id"]) if "x-page-id" in http else None, fields["URL"], fields["Archive-date"],
                         hashlib.sha256(payload).hexdigest(), len(payload)) for at, fields, http, _, payload in arc_records(_plain(content))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                                 names=["path", "at", "page_id", "url", "date", "digest", "n_bytes"])

    return _read(spark, path).mapInArrow(index, _PLACES)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Converts the ARC archives below ``arc_path``; one WARC archive each."""
    index = C.saved(arc_index(spark, arc_path), "arc-index").where((F.col("n_bytes") >= min_revisit) & F.col("page_id").isNotNull())
    first = (index.groupBy("digest").agg(F.min(F.struct("page_id", "url", "date")).alias("first"), F.max("page_id").alias("_last"))
             .where(F.col("first.page_id") < F.col("_last")).select("digest", "first"))
    revisits = (index.join(first, "digest").where(F.col("page_id") > F.col("first.page_id"))
                .groupBy("path").agg(F.collect_list(F.struct("at", "digest", "first")).alias("revisits")))

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, marks in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "revisits")), strict=True):
                again, out = {m["at"]: m for m in marks or ()}, []
                for at, fields, http, head, payload in arc_records(_plain(content)):
                    original = None
                    if at in again:
                        f = again[at]["first"]
                        date = datetime.strptime(f["date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                        original = {"id": record_id(str(f["page_id"]), f["url"], date, again[at]["digest"], ""), "url": f["url"], "date": date}
                    out.append(warc_record(fields, http, head, payload, f"{name}:{at}", original))
                if out:
                    yield _as_batch(b"".join(out))

    archives = _read(spark, arc_path).join(revisits, "path", "left").select("path", "content", "revisits")
    _write(archives.mapInArrow(converted, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to_id, block."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = []
                for h, block in warc_records(_plain(content)):
                    cut = block.index(b"\r\n\r\n") + 4
                    http = http_headers(block[:cut])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(http["content-length"])
                    if h["WARC-Type"] == "response" and (len(block) - cut != size or hashlib.sha256(block[cut:]).hexdigest() != digest):
                        raise ValueError(f"payload of {h['WARC-Record-ID']}")
                    url = h["WARC-Target-URI"]
                    rows.append((h["WARC-Record-ID"], int(http["x-page-id"]) if "x-page-id" in http else None, None if url == "-" else url,
                                 h["WARC-Type"], size, digest, h.get("WARC-Refers-To"), block))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                                 names=["record_id", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to_id", "block"])

    return _read(spark, path).mapInArrow(records, "record_id string, page_id bigint, url string, record_type string, payload_bytes bigint, "
                                                  "payload_digest string, refers_to_id string, block binary")


def with_targets(records: DataFrame) -> DataFrame:
    """Adds refers_to, the page_id of the response that a revisit names."""
    responses = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    return records.join(responses, "refers_to_id", "left")


def scratch(spark: SparkSession, label: str) -> str:
    return unique_dir(spark, label)

