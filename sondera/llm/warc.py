"""Legacy web archives to WARC.

An ARC file begins with a version block, whose lines name the version and the
fields of the record headers: five fields in version 1, ten in version 2.  Each
record is a header line and a body of the length that the line declares.  The
converter reads records by those lines and lengths and synthesises for each the
WARC record that it stands for: a record id, an ISO timestamp from the 14-digit
date, the record type, and payload and block digests.

Of records with equal payloads of at least ``least_revisit`` bytes the one with
the smallest page_id is the response; the others are revisits that name it and
carry its HTTP header without the body.  Records are gzip members of their own.

Defined results: null html is an empty payload; null or odd urls are quoted so
that a header line keeps its fields; an empty table writes no archive; rows
with equal page_id and payload are all responses where that page_id is the
smallest; a null page_id is a response of its own; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LEAST_REVISIT, PART_BYTES = 100, 1 << 28
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_SPACE = uuid.UUID("6f1c0f52-6d0b-5c53-9a3e-52f6a1b0c9d4")


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    body: bytes


def arc_version_block(name: str, version: int, date: str = "20240101000000") -> bytes:
    body = f"{version} 0 sondera\n{' '.join(FIELDS[version])}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"}[version]
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content_type: str, body: bytes, ip: str = "0.0.0.0", code: str = "200", name: str = "-") -> bytes:
    values = {"URL": quote(url, safe=":/?#[]@!$&'()*+,;=%~") or "-", "IP-address": ip, "Archive-date": date, "Content-type": content_type, "Result-code": code, "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        values = line.split(" ")
        if line.startswith("filedesc://"):
            length = int(values[-1])
            body = data[end + 1 : end + 1 + length]
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            named = body.split(b"\n")[1].decode().split(" ")
            fields = named if len(named) == len(FIELDS[version]) else FIELDS[version]
        else:
            if len(values) < len(fields):
                raise ValueError(f"header line has {len(values)} fields instead of {len(fields)}: {line[:200]}")
            # A content type may hold spaces; the fields before and after it may not.
            extra = len(values) - len(fields)
            values[3 : 4 + extra] = [" ".join(values[3 : 4 + extra])]
            record = dict(zip(fields, values, strict=True))
            length = int(record["Archive-length"])
            body = data[end + 1 : end + 1 + length]
            if len(body) < length:
                raise ValueError(f"a record of {length} bytes ends after {len(body)}")
            yield ArcRecord(record, body)
        at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, if there is one, and the payload."""
    if body[:5] == b"HTTP/":
        for mark in (b"\r\n\r\n", b"\n\n"):
            at = body.find(mark)
            if at >= 0:
                return body[: at + len(mark)], body[at + len(mark) :]
    return b"", body


def iso_date(date: str) -> str:
    d = (date + "00000000000000")[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{max(d[4:6], '01')}-{max(d[6:8], '01')}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    """A record id that a retried task makes again."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, key)}>"


def to_warc(arc: ArcRecord, key: str, refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit of the record with key ``refers_to``, if given."""
    header, payload = split_http(arc.body)
    url, http = arc.fields["URL"], bool(header)
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    block = arc.body if refers_to is None else header
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    lines = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(key), "WARC-Date": iso_date(arc.fields["Archive-date"]), "WARC-Target-URI": url, "WARC-IP-Address": arc.fields["IP-address"],
        "WARC-Payload-Digest": digest, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response" if http else arc.fields["Content-type"],
    } | (extra or {})
    if refers_to is not None:
        lines |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip()] = v.strip()
        yield head, stream.read(int(head["Content-Length"]))


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def with_first(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html and ``first``: the page that a page revisits, or null."""
    p = shared.bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    same = F.when(F.col("page_id").isNotNull() & (F.octet_length("html") >= least), F.sha2("html", 256))
    p = p.withColumn("same", same)
    slim = p.select("page_id", "same").where("same is not null")
    groups = slim.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Who revisits whom is settled without the pages; these then meet it by their own ids,
    # so that pages of one payload do not meet in one task.
    revisits = shared.materialize(slim.join(groups, "same").where("page_id <> first").distinct(), "revisits")
    spread = F.coalesce("page_id", F.xxhash64("url", "html"))
    return p.withColumn("at", spread).join(revisits.withColumnRenamed("page_id", "at"), ["at", "same"], "left").select("page_id", "url", "html", "first")


def write(pages: DataFrame, least: int = LEAST_REVISIT, date: str = "20240101000000", part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the pages to WARC files in the shared folder by way of ARC records of both
    versions in turn; returns the manifest (path, n_records, n_bytes)."""
    folder = shared.new_folder(pages.sparkSession, "warc")

    def members(batches, seen):
        blocks = {v: arc_version_block("pages", v) for v in FIELDS}
        for b in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen["n"] += 1
                version = 1 + seen["n"] % 2
                raw = blocks[version] + arc_record(version, url or "", date, "text/html; charset=utf-8", _http(html.encode()))
                (arc,) = parse_arc(raw)
                extra = {} if page is None else {"X-Page-Id": str(page)}
                key = f"page:{page}" if page is not None else f"null:{seen['part']}:{seen['n']}:{url}"
                record = to_warc(arc, key, None if first is None else f"page:{first}", extra | ({} if first is None else {"X-Refers-To-Page-Id": str(first)}))
                yield gzip.compress(record, 4, mtime=0)

    def put(batches):
        part = TaskContext.get().partitionId()
        seen, stream = {"n": 0, "part": part}, None
        stream = members(batches, seen)
        number = 0
        while (one := next(stream, None)) is not None:
            before = seen["n"] - 1

            def some(one=one):
                size = len(one)
                yield one
                while size < part_bytes and (more := next(stream, None)) is not None:
                    size += len(more)
                    yield more

            path, n = shared.write_file(folder, f"{part:06d}-{number:04d}", some())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([seen["n"] - before], pa.int64()), pa.array([n], pa.int64())], names=["path", "n_records", "n_bytes"])
            number += 1

    return shared.materialize(with_first(pages, least).mapInArrow(shared.tidy(put), "path string, n_records long, n_bytes long"), "warc_manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to, record_id, url, warc_date and, if asked for, payload.
    Digests of responses are computed from the payload and compared with the header."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date"] + ["payload"] * payloads
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads

    def rows_of(path):
        with shared.read_file(path) as f, io.BufferedReader(gzip.GzipFile(fileobj=f)) as stream:
            for head, block in parse_warc(stream):
                header, payload = split_http(block)
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                size = len(payload)
                if head["WARC-Type"] == "revisit":
                    size = next(int(x.partition(b":")[2]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: {head['WARC-Record-ID']} has another payload than its digest says")
                page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                if refers and record_id(f"page:{refers}") != head["WARC-Refers-To"]:
                    raise ValueError(f"{path}: {head['WARC-Record-ID']} refers to another record than its page says")
                row = (page and int(page), size, digest, head["WARC-Type"], refers and int(refers), head["WARC-Record-ID"], unquote(head["WARC-Target-URI"]), head["WARC-Date"])
                yield (*row, payload) if payloads else row

    def work(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) >= (64 if payloads else 2048):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string" + ", payload binary" * payloads
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(shared.tidy(work), schema)


def convert_arc(data: bytes, key_prefix: str = "arc") -> Iterator[bytes]:
    """The WARC records of an ARC file, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest:
            d = zlib.decompressobj(31)
            plain.append(d.decompress(rest) + d.flush())
            rest = d.unused_data
        data = b"".join(plain)
    for n, arc in enumerate(parse_arc(data)):
        yield to_warc(arc, f"{key_prefix}:{n}:{arc.fields['URL']}:{arc.fields['Archive-date']}")
