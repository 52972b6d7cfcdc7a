"""Legacy ARC archives to WARC, written, and read back.

An ARC file opens with a version block whose lines state the version and the
fields of every record line; a record is its line, as many bytes as the line
declares, and a line end. Version 1 records have five fields, version 2 ten. The
converter reads them by what the version block says, and makes up what WARC wants
beyond that: a record id (a UUID of the record's content and place, so reruns
agree), a date in ISO form, a type and digests.

WARC files are written as text by Spark's own writer, one record per row: a
record ends in CR LF CR LF, of which the last byte is the writer's line end. They
are gzip files with a bounded number of records, read back as whole files. Of
records with equal payloads of at least ``MIN_REVISIT`` bytes, one is a response
and the others revisits without payload.

Defined cases: a null html is an empty payload; a null or odd url is escaped; rows
with equal ids are records of their own, and if they hold the largest id of equal
payloads each is a response; a null id never is the one kept, unless all are null;
an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.llm.common import cut, shared_folder, stored

MIN_REVISIT = 1000
RECORDS_PER_FILE = 1000
#: The fields of a record line, by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
STAMP = "20010101000000"
# The beginning of a record line: URL, address, date.
_ARC_LINE = re.compile(rb"\n[a-z][a-z0-9+.-]{0,20}:[^\n]{0,4000} [0-9a-fA-F.:]{3,45} \d{8,14} [^\n]{0,200}\d\r?\n", re.IGNORECASE)
#: Bytes of an archive that are inflated at a time.
INFLATED = 1 << 22
CRLF = b"\r\n"


@dataclass
class ArcRecord:
    """One record: the fields of its line by name (lower case), and its payload."""

    version: int
    fields: dict[str, str]
    payload: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def arc_url(url: str | None) -> str:
    """A URL without bytes that would part fields or lines."""
    return urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))) if url else "-"


def arc_bytes(version: int, records: list[tuple[str | None, bytes]], stamp: str = STAMP) -> bytes:
    """An ARC file of these urls and payloads."""
    block = f"{version} 0 storefront\n{FIELDS[version]}\n".encode()
    out = []

    def add(url: str, mime: str, payload: bytes) -> None:
        line = [url, "0.0.0.0", stamp, mime]
        if version == 2:
            line += ["200", "-", "-", str(sum(map(len, out))) if len(out) < 2 else "-", "storefront.arc"]
        out.extend((" ".join([*line, str(len(payload))]).encode() + b"\n", payload, b"\n"))

    add("filedesc://storefront.arc", "text/plain", block)
    for url, payload in records:
        add(arc_url(url), "text/html", payload)
    return b"".join(out)


@dataclass
class BadRecord:
    """Bytes of an archive that are no record: where they begin, and why."""

    place: int
    reason: str


def _record_fields(line: str, names: list[str]) -> dict[str, str]:
    """The fields of a record line by name; blanks beyond their number belong to the URL, which comes first."""
    parts = line.split(" ")
    if len(parts) < len(names):
        raise ValueError(f"{len(parts)} fields, the version block names {len(names)}")
    extra = len(parts) - len(names) + 1
    fields = dict(zip(names, [" ".join(parts[:extra]), *parts[extra:]]))
    if not re.fullmatch(r"\d{8,14}", fields["archive-date"], re.ASCII):
        raise ValueError(f"the fields have no date: {line[:200]}")
    return fields


def scan_arc(data: bytes) -> Iterator[ArcRecord | BadRecord]:
    """The records after the version block, cut by their declared lengths.

    After bytes that are no record reading goes on at the next line that could begin one.
    """
    at, names, version = 0, [], 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if not line and end >= 0:
            at = end + 1
            continue
        try:
            if end < 0:
                raise ValueError(f"no line end after byte {at}")
            length = int(line.rsplit(" ", 1)[-1])
            payload = data[end + 1 : end + 1 + length]
            if length < 0 or len(payload) != length:
                raise ValueError(f"record at byte {at} declares {length} bytes, {len(payload)} are left")
            if line.startswith("filedesc:"):
                head, names_line = payload.decode("utf-8", "replace").split("\n")[:2]
                version, names = int(head.split(" ")[0]), names_line.lower().split()
                if version not in FIELDS:
                    raise ValueError(f"ARC version {version}")
            elif not names:
                raise ValueError("a record before the version block")
            else:
                yield ArcRecord(version, _record_fields(line, names), payload)
        except ValueError as error:
            yield BadRecord(at, str(error))
            found = _ARC_LINE.search(data, end) if end >= 0 else None
            at = len(data) if found is None else found.start() + 1
            continue
        at = end + 1 + length
        if at < len(data) and data[at : at + 1] == b"\n":
            at += 1


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of ``scan_arc``; bytes that are none are an error."""
    for record in scan_arc(data):
        if isinstance(record, BadRecord):
            raise ValueError(record.reason)
        yield record


def iso_date(stamp: str) -> str:
    """``yyyymmddhhmmss`` (version 1 may stop after the day) as WARC writes it."""
    digits = re.sub(r"\D", "", stamp).ljust(14, "0")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def digest_header(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest.hex()}')}>"


def http_body(payload: bytes) -> bytes:
    """What follows the head of an HTTP response; all of a payload that has none."""
    if not payload.startswith(b"HTTP/"):
        return payload
    ends = [at + len(gap) for gap in (b"\r\n\r\n", b"\n\n") if (at := payload.find(gap)) >= 0]
    return payload[min(ends) :] if ends else b""


def captured_warc(record: ArcRecord, file: str, place: int) -> WarcRecord:
    """The WARC record of one from a crawl: its block as it is, with the digest of the payload in it.

    Look-ups of names are resources; what an HTTP server sent is a response with its head.
    """
    scheme = record.fields["url"].split(":", 1)[0].lower()
    http = scheme in ("http", "https")
    headers = {
        "WARC-Type": "response" if http else "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}/{place}/{hashlib.sha1(record.payload).hexdigest()}')}>",
        "WARC-Date": iso_date(record.fields["archive-date"]),
        "WARC-Target-URI": arc_url(record.fields["url"]),
        "WARC-IP-Address": record.fields["ip-address"],
        "WARC-Block-Digest": digest_header(hashlib.sha1(record.payload).digest()),
        "WARC-Payload-Digest": digest_header(hashlib.sha1(http_body(record.payload) if http else record.payload).digest()),
        "Content-Type": "application/http; msgtype=response" if http and record.payload.startswith(b"HTTP/") else record.fields["content-type"],
        "X-Arc-Version": str(record.version),
    }
    return WarcRecord(headers, record.payload)


def to_warc(record: ArcRecord, page_id: int | None, refers_to: int | None) -> WarcRecord:
    """The WARC record of an ARC record; a revisit if it refers to another page."""
    digest = hashlib.sha1(record.payload).digest()
    revisit = refers_to is not None
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": iso_date(record.fields["archive-date"]),
        "WARC-Target-URI": record.fields["url"],
        "WARC-IP-Address": record.fields["ip-address"],
        "WARC-Payload-Digest": digest_header(digest),
        "Content-Type": record.fields["content-type"],
        "X-Arc-Version": str(record.version),
        "X-Payload-Length": str(len(record.payload)),
    }
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if revisit:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = record_id(refers_to, digest)
        headers["X-Refers-To-Page"] = str(refers_to)
        return WarcRecord(headers)
    headers["WARC-Block-Digest"] = digest_header(digest)
    return WarcRecord(headers, record.payload)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in record.headers.items()), f"Content-Length: {len(record.payload)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + record.payload + CRLF * 2


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file in pieces of bounded size; it may have any number of members."""
    while data:
        member = zlib.decompressobj(wbits=31)
        while data and not member.eof:
            yield member.decompress(data, INFLATED)
            data = member.unconsumed_tail
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")


def read_warc(pieces: bytes | Iterator[bytes]) -> Iterator[WarcRecord]:
    """The records of a file, cut by their declared lengths; one record is held at a time."""
    source = iter([pieces] if isinstance(pieces, bytes) else pieces)
    data, at, base = b"", 0, 0

    def more() -> bool:
        nonlocal data, at, base
        piece = next(source, None)
        if piece is not None:
            data, at, base = data[at:] + piece, 0, base + at
        return piece is not None

    while at < len(data) or more():
        if at == len(data):
            continue
        while (end := data.find(CRLF * 2, at)) < 0 and more():
            pass
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {base + at}")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        length, head = int(headers.pop("Content-Length")), end + 4 - at
        while len(data) - at < head + length + 4 and more():
            pass
        start = at + head
        if data[start + length : start + length + 4] != CRLF * 2:
            raise ValueError(f"record at byte {base + at} does not end after {length} bytes")
        yield WarcRecord(headers, data[start : start + length])
        at = start + length + 4


def keepers(pages: DataFrame) -> DataFrame:
    """``digest, keeper``: the largest id of each payload that occurs more than once."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    long = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    groups = long.where(F.col("n") >= MIN_REVISIT).groupBy("digest")
    return groups.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")


def warc_rows(pages: DataFrame) -> DataFrame:
    """``record``: each page's WARC record without its last byte, made by way of ARC bytes of both versions."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload).alias("digest")
    )
    table = cut(keepers(pages.select(F.col("page_id").cast("long").alias("page_id"), "html")))
    rows = rows.join(table, "digest", "left").select("page_id", "url", "html", "keeper")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256).to_pydict()
                records: list[bytes] = []
                for version in FIELDS:
                    own = [i for i, p in enumerate(part["page_id"]) if (p or 0) % len(FIELDS) == version - 1]
                    arc = arc_bytes(version, [(part["url"][i], part["html"][i].encode()) for i in own])
                    for i, record in zip(own, read_arc(arc), strict=True):
                        page, keeper = part["page_id"][i], part["keeper"][i]
                        other = keeper if keeper is not None and keeper != page else None
                        records.append(warc_bytes(to_warc(record, page, other))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).cast(pa.string())], ["record"])

    return rows.mapInArrow(convert, "record string")


def write_warc(pages: DataFrame, folder: str) -> None:
    """All pages as WARC files in ``folder``."""
    _write(warc_rows(pages), folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the WARC files in ``folder``, its digest verified where it has a payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for record in read_warc(inflated(content.as_py())):
                    head = record.headers
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:"))
                    revisit = head["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(record.payload).digest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                    page, other = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    rows.append(
                        (
                            None if page is None else int(page),
                            int(head["X-Payload-Length"]) if revisit else len(record.payload),
                            digest.hex(),
                            head["WARC-Type"],
                            None if other is None else int(other),
                            head["WARC-Record-ID"],
                            head["WARC-Date"],
                            int(head["X-Arc-Version"]),
                        )
                    )
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "arc_version"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(
        parse,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, date string, arc_version int",
    )


def arc_records(spark: SparkSession, folder: str) -> DataFrame:
    """``file, place, record, url, record_type, payload_bytes, payload_digest, error`` of the ARC files in ``folder``.

    Files may be gzip files of any number of members. ``record`` is the WARC record that
    ``place`` (from 0) of a file becomes; where bytes are no record only ``error`` says why,
    and the rest of the file is read on. A file that cannot be inflated is one such row.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["file", "place", "record", "url", "record_type", "payload_bytes", "payload_digest", "error"]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                file, data = path.rsplit("/", 1)[-1], content.as_py()
                try:
                    data = b"".join(inflated(data)) if data.startswith(b"\x1f\x8b") else data
                except (ValueError, zlib.error) as error:
                    data, failed = b"", [(file, None, None, None, None, None, None, str(error))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*failed), kinds)], names)
                rows, size = [], 0
                for place, found in enumerate(scan_arc(data)):
                    if isinstance(found, BadRecord):
                        rows.append((file, place, None, None, None, None, None, found.reason))
                        continue
                    warc = captured_warc(found, file, place)
                    digest = base64.b32decode(warc.headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    body = http_body(found.payload) if warc.headers["WARC-Type"] == "response" else found.payload
                    record = warc_bytes(warc)[:-1]
                    rows.append((file, place, record, found.fields["url"], warc.headers["WARC-Type"], len(body), digest, None))
                    size += len(record)
                    if size > INFLATED:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").load(folder).select("path", "content")
    return files.mapInArrow(
        parse,
        "file string, place long, record binary, url string, record_type string, payload_bytes long, payload_digest string, error string",
    )


def convert_archives(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Writes the ARC files of ``folder`` as WARC files to ``out``; returns ``arc_records`` without the records."""
    found = stored(arc_records(spark, folder))
    records = found.where("record IS NOT NULL").select(F.col("record").cast("string").alias("record"))
    _write(records, out)
    return found.drop("record")


def _write(records: DataFrame, folder: str) -> None:
    writer = records.write.option("lineSep", "\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as WARC files to the shared folder and reads them back, one row per record."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4()}"
    write_warc(pages, folder)
    return read_archives(spark, folder)
