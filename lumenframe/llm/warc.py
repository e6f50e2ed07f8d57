"""Web archives: ARC files of either version converted to WARC 1.1, written, and read back.

An ARC record is a header line, whose fields depend on the version that the file's first block declares, and as
many bytes as the line's last field says. The converter reads these and synthesises what WARC asks for and ARC
lacks: record identifiers, ISO timestamps, record types and digests.

WARC files are written by Spark's own writer, a record a row with the two line ends that close a record as line
separator, so they can go to any file system that Spark writes to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_map, join_checked, materialise, scratch_path

#: The fields of ARC header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of URLs, RFC 4122
ARC_BYTES = 8 << 20  # of pages that are put into one ARC file in memory
FILE_RECORDS = 2000  # of a WARC file


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    status: int | None
    body: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


# --- ARC ----------------------------------------------------------------------------------------------------


def arc_file(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of the version: its description block, then the records."""
    fields = " ".join(ARC_FIELDS[version])
    about = f"{version} 0 lumenframe\n{fields}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 20200101000000 text/plain{extra} {len(about)}\n".encode(), about, b"\n"]
    for r in records:
        middle = f" {r.status or '-'} {base32_sha1(r.body)} - 0 {name}" if version == 2 else ""
        out += [f"{r.url} {r.ip} {r.date} {r.content_type}{middle} {len(r.body)}\n".encode(), r.body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its description block."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if not line:  # between records
            at += 1
            continue
        parts = line.split(" ")
        if end < 0 or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        start, size = end + 1, int(parts[-1])
        body = data[start : start + size]
        if len(body) < size:
            raise ValueError(f"ARC record of {size} bytes ends after {len(body)}")
        at = start + size
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file starts with a filedesc block")
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields = ARC_FIELDS[version]
            continue
        if len(parts) < len(fields):
            raise ValueError(f"{len(parts)} fields where the version has {len(fields)}")
        # A content type with spaces spills into further parts; the url has none and the rest is counted from both ends.
        after = len(fields) - 4
        got = dict(zip(fields[4:], parts[len(parts) - after :]))
        code = got.get("Result-code", "")
        yield ArcRecord(parts[0], parts[1], parts[2], " ".join(parts[3 : len(parts) - after]), int(code) if code.isdigit() else None, body)


# --- WARC ---------------------------------------------------------------------------------------------------


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response with its blank line, and its payload; no head if it isn't one."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    cut = body.find(b"\r\n\r\n")
    return (body, b"") if cut < 0 else (body[: cut + 4], body[cut + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}|{digest}')}>"


def timestamp(date: str) -> str:
    """An ARC date of 12 or 14 digits in the form that WARC has."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: ArcRecord, revisits: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the blank lines that close it.

    revisits: the id of the page whose response has the same payload; the record then has the HTTP head alone.
    """
    head, payload = http_parts(r.body)
    digest = base32_sha1(payload)
    page = http_field(head, "X-Page-Id")
    block = head if revisits is not None else r.body
    kind = "revisit" if revisits is not None else "response" if head else "resource"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", timestamp(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip if r.ip != "0.0.0.0" else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else r.content_type),
    ]
    if revisits is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(str(revisits), digest)), ("X-Refers-To-Page-Id", str(revisits))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, by the lengths they declare."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        cut = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or cut < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:cut].decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[cut + 4 : cut + 4 + size]
        if len(block) < size:
            raise ValueError(f"WARC record of {size} bytes ends after {len(block)}")
        yield fields, block
        at = cut + 4 + size


def _arc_record(page_id: int | None, url: str | None, page: bytes, date: str) -> ArcRecord:
    who = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{who}Content-Length: {len(page)}\r\n\r\n"
    return ArcRecord(quote(url or "about:blank", safe="/:?#[]@!$&'()*+,;=%~-._"), "0.0.0.0", date, "text/html", 200, head.encode() + page)


def pages_to_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "20200101000000") -> None:
    """Write a WARC record per row below path, by way of ARC files of both versions in memory.

    Of rows with equal payloads of at least least_bytes bytes the one with the largest id is a response and the
    others revisit it; rows repeated under that id are responses each, as are rows with a null id where all ids of
    the payload are null.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("page"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("page")))
    same = rows.where(F.octet_length("page") >= least_bytes).groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    same = materialise(same.select("sha", "top"), "payloads")
    marked = join_checked(rows, same, "sha", "left", 64)
    marked = marked.select("id", "url", "page", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("revisits"))
    schema = pa.schema([("record", pa.binary())])

    def convert(batches):
        version = 1
        for batch in batches:
            ids, urls, revisits = (batch.column(c).to_pylist() for c in ("id", "url", "revisits"))
            some, size, marks = [], 0, []
            for i, page in enumerate(batch.column("page")):
                body = page.as_py()
                some.append(_arc_record(ids[i], urls[i], body, date))
                marks.append(revisits[i])
                size += len(body)
                if size >= ARC_BYTES or i + 1 == batch.num_rows:
                    arc = arc_file(some, version)
                    out = [warc_record(r, m) for r, m in zip(parse_arc(arc), marks, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)
                    some, size, marks, version = [], 0, [], 3 - version

    records = marked.mapInArrow(convert, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below path: (page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, date)."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string())])

    def read(batch: pa.RecordBatch) -> dict:
        out = {f.name: [] for f in schema}
        for content in batch.column("content"):
            for fields, block in parse_warc(content.as_py()):
                head, payload = http_parts(block)
                kind = fields["warc-type"]
                declared = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit" and base32_sha1(payload) != declared:
                    raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have the digest it declares")
                page, refers = http_field(head, "X-Page-Id"), fields.get("x-refers-to-page-id")
                out["page_id"].append(int(page) if page else None)
                out["payload_bytes"].append(int(http_field(head, "Content-Length")) if kind == "revisit" else len(payload))
                out["payload_digest"].append(declared)
                out["record_type"].append(kind)
                out["refers_to"].append(int(refers) if refers else None)
                out["record_id"].append(fields["warc-record-id"])
                out["url"].append(fields.get("warc-target-uri"))
                out["date"].append(fields["warc-date"])
        return out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(arrow_map(read, schema), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC to a scratch folder and read them back: a row per row of pages, as read_warc has them.

    A null page has an empty payload, a null id none, a null url ``about:blank``; other columns are not read. An
    empty table gives an empty result.
    """
    path = scratch_path(pages.sparkSession, "warc")
    pages_to_warc(pages, path, id_col, url_col, html_col, least_bytes)
    return read_warc(pages.sparkSession, path).withColumnRenamed("page_id", id_col)
