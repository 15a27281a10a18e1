"""Legacy ARC archives to WARC: version-specific ARC header lines in, equivalent WARC records out.

``write_arc`` makes ARC files of a page table, ``read_arc`` parses such files by the field names their version block
declares and by the declared lengths, ``to_warc`` converts stored ARC files into stored WARC files with synthesised
identifiers, timestamps, types and digests, and ``read_warc`` parses these. A record is named by its ARC file and its
place there, so every identifier is unique and a revisit can name the record it refers to. Of HTTP records with equal
payloads the one with the largest page id is the response, the others are revisits of it; a record that isn't an HTTP
response (``dns:``) becomes a ``resource`` with its own content type; the version block of a file becomes ``warcinfo``.

Defined cases: a null page has an empty payload; a null url becomes ``urn:page:<id>``; a null page id is never the
largest unless it stands alone, and such rows revisit the largest id; rows that repeat the largest id are all
responses; an empty table gives empty archives. Broken ARC or WARC bytes fail the job.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle, small_batches

# Field names of the header lines of ARC versions 1 and 2.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRAWLED = "20240101000000"
UNKNOWN_IP = "0.0.0.0"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_file(name: str, pages: list[tuple[int | None, str | None, bytes]], version: int) -> bytes:
    """An ARC file of (page id, url, payload) rows."""
    fields = f"{version} 0 quotemill\n{ARC_FIELDS[version]}\n\n".encode()
    extra = ["200", "-", "-", "0", name] if version == 2 else []
    head = " ".join([f"filedesc://{name}", UNKNOWN_IP, CRAWLED, "text/plain", *extra, str(len(fields))])
    out, size = [head.encode(), b"\n", fields], len(head) + 1 + len(fields)
    for number, url, payload in pages:
        own = "" if number is None else f"X-Page-Id: {number}\r\n"
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
        place = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{number}"
        extra = ["200", hashlib.md5(payload, usedforsecurity=False).hexdigest(), "-", str(size), name] if version == 2 else []
        line = " ".join([place, UNKNOWN_IP, CRAWLED, "text/html", *extra, str(len(body) + len(payload))]).encode()
        out += [line, b"\n", body, payload, b"\n"]
        size += len(line) + 2 + len(body) + len(payload)
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header fields, content) of each record, the version block first."""
    fields = ARC_FIELDS[1].split(" ")
    at = 0
    while at < len(data):
        if at and data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode().split(" ")
        if not at:  # its line has the fields of its version, which its block declares
            stop = end + 1 + int(values[-1])
            version, names = data[end + 1 : stop].split(b"\n")[:2]
            if int(version.split(b" ")[0]) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            fields = names.decode().split(" ")
        if len(values) != len(fields):
            raise ValueError(f"ARC header line at byte {at} has {len(values)} fields, not {len(fields)}")
        head = dict(zip(fields, values, strict=True))
        stop = end + 1 + int(head["Archive-length"])
        if stop > len(data):
            raise ValueError(f"ARC record at byte {at} breaks off")
        yield at, head, data[end + 1 : stop]
        at = stop


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields, header bytes, payload) of an HTTP response."""
    end = content.find(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or end < 0:
        return {}, b"", content
    lines = content[:end].decode("latin-1").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, content[: end + 4], content[end + 4 :]


def warc_time(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_record(kind: str, own_id: str, url: str, date: str, content_type: str, content: bytes, more: list[tuple[str, str]]) -> bytes:
    """One gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), *[("WARC-Target-URI", url)] * bool(url), *more]
    head += [("WARC-Block-Digest", f"sha1:{digest(content)}"), ("Content-Type", content_type), ("Content-Length", str(len(content)))]
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + content + b"\r\n\r\n", 1, mtime=0)


def warc_file(archive: str, data: bytes, refers: dict[int, dict]) -> bytes:
    """The WARC file of an ARC file. ``refers``: for the place of each revisit the archive, place, page_id, url and warc_date
    of the record it refers to. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    out, info = [], record_id(archive, 0)
    for place, head, content in arc_records(data):
        date = warc_time(head["Archive-date"])
        if not place:
            text = f"software: quotemill\r\nformat: WARC File Format 1.0\r\ndescription: {' '.join(content.decode().split())}\r\n"
            out.append(warc_record("warcinfo", info, "", date, "application/warc-fields", text.encode(), [("WARC-Filename", warc_name(archive))]))
            continue
        fields, http, body = http_parts(content)
        more = [("WARC-Warcinfo-ID", info), ("WARC-Payload-Digest", f"sha1:{digest(body)}")]
        if head["IP-address"] != UNKNOWN_IP:
            more.append(("WARC-IP-Address", head["IP-address"]))
        to = refers.get(place)
        if to is not None:
            more += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(to["archive"], to["place"]))]
            more += [("WARC-Refers-To-Target-URI", to["url"]), ("WARC-Refers-To-Date", to["warc_date"]), ("X-Refers-To-Page-Id", str(to["page_id"]))]
        kind, content_type = ("revisit" if to is not None else "response", "application/http; msgtype=response") if http else ("resource", head["Content-type"])
        out.append(warc_record(kind, record_id(archive, place), head["URL"], date, content_type, http if to is not None else content, more))
    return b"".join(out)


def warc_name(archive: str) -> str:
    return archive.removesuffix(".arc") + ".warc.gz"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record of a gzipped WARC file."""
    plain, at = gzip.decompress(data) if data else b"", 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        yield head, plain[end + 4 : stop]
        at = stop + 4


ARC_ROWS = "archive string, place long, page_id long, url string, warc_date string, warc_type string, payload_bytes long, payload_digest string"
_ARC_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
_ARC_NAMES = [c.strip().split(" ")[0] for c in ARC_ROWS.split(",")]


def write_arc(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", version: int | None = None) -> DataFrame:
    """ARC files of the pages: ``archive`` (name) and ``content``, one for each bounded step of a task; without a ``version``
    files of both by turns."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for part in small_batches(batches, "html"):
            rows = zip(part.column("key").to_pylist(), part.column("url").to_pylist(), part.column("html").cast(pa.binary()).to_pylist(), strict=True)
            name = f"pages-{task:07}-{turn:05}.arc"
            data = arc_file(name, [(k, u, h or b"") for k, u, h in rows], version or 1 + turn % 2)
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["archive", "content"])

    chosen = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return chosen.mapInArrow(run, "archive string, content binary")


def read_arc(archives: DataFrame, *, payload: bool = False) -> DataFrame:
    """The records of ARC files (``archive``, ``content``) but for their version blocks; ``payload``: with HTTP header and payload."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive"), batch.column("content"), strict=True):
                rows = []
                for place, head, content in arc_records(data.as_py()):
                    if place:
                        fields, http, body = http_parts(content)
                        number = fields.get("x-page-id")
                        row = (name.as_py(), place, None if number is None else int(number), head["URL"], warc_time(head["Archive-date"]), "response" if http else "resource", len(body), digest(body))
                        rows.append((*row, http, body) if payload else row)
                names, types = [*_ARC_NAMES, *["http", "payload"] * payload], [*_ARC_TYPES, *[pa.binary(), pa.binary()] * payload]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return archives.select("archive", "content").mapInArrow(run, ARC_ROWS + ", http binary, payload binary" * payload)


def revisits(records: DataFrame, *, least: int = 0) -> DataFrame:
    """(archive, place, refers) of those HTTP records whose payload, of ``least`` bytes or more, a record with a larger page
    id has too. The records of a payload, however many, meet in one small row for each task and payload."""
    own = records.filter((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least))
    own = own.select("archive", "place", "page_id", "payload_digest", F.struct("page_id", "archive", "place", "url", "warc_date").alias("refers"))
    groups = own.groupBy("payload_digest").agg(F.max("refers").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 and top.page_id is not null")
    groups = settle(groups)  # written, so that Spark can split the records of a common payload
    found = own.join(groups, "payload_digest").filter("page_id is null or page_id < top.page_id")
    return found.select("archive", "place", F.col("top").alias("refers"))


def to_warc(archives: DataFrame) -> DataFrame:
    """Stored ARC files (``archive``, ``content``) to WARC files kept in the shared folder: ``archive`` and ``content``.

    The files are read twice: for the digests of their records, from which it is found which record revisits which, and
    to be converted, each file with the list of its own revisits.
    """
    lists = revisits(read_arc(archives)).groupBy("archive").agg(F.collect_list(F.struct("place", "refers")).alias("found"))

    @lean
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, content, found = (batch.column(c)[row].as_py() for c in ("archive", "content", "found"))
                made = warc_file(name, content, {x["place"]: x["refers"] for x in found or ()})
                yield pa.RecordBatch.from_arrays([pa.array([warc_name(name)]), pa.array([made], pa.binary())], ["archive", "content"])

    joined = archives.select("archive", "content").join(lists, "archive", "left")
    return settle(joined.mapInArrow(convert, "archive string, content binary"))


def read_warc(archives: DataFrame, *, payload: bool = False, links: bool = False) -> DataFrame:
    """The records of WARC files but for ``warcinfo``; ``links``: with ``record_id`` and ``refers_to_id``, ``payload``: with the
    stored payload. A digest that doesn't match its content fails the job."""
    added = [*[("record_id", "string"), ("refers_to_id", "string")] * links, *[("payload", "binary")] * payload]
    fields = [("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("url", "string"), ("warc_date", "string"), *added]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, content in warc_records(data.as_py()):
                    kind = head["warc-type"]
                    if head["warc-block-digest"] != f"sha1:{digest(content)}":
                        raise ValueError(f"digest of {head['warc-record-id']} doesn't match")
                    if kind == "warcinfo":
                        continue
                    http, _, body = ({}, b"", content) if kind == "resource" else http_parts(content)
                    own = head["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and own != digest(body):
                        raise ValueError(f"payload digest of {head['warc-record-id']} doesn't match")
                    size = int(http["content-length"]) if kind == "revisit" else len(body)
                    number, to = http.get("x-page-id"), head.get("x-refers-to-page-id")
                    row = (None if number is None else int(number), size, own, kind, None if to is None else int(to), head["warc-target-uri"], head["warc-date"])
                    rows.append((*row, *(head["warc-record-id"], head.get("warc-refers-to")) * links, *(body,) * payload))
                columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return archives.select("content").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))
