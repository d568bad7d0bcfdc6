"""Legacy ARC archives, converted to WARC, written and read back.

An ARC file starts with a version block that names the fields of its header lines;
version 1 and 2 differ in them. The converter reads each declared length, and makes
up what WARC needs and ARC lacks: record ids, ISO dates, types and digests. Equal
payloads become revisits of one response. Archives are files in the shared folder,
written under a temporary name and renamed, so a repeated task replaces its own files;
they are read with Spark's binary source.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from docweave.llm.blocks import stored
from docweave.session import work_path

#: Bytes of records after which a task starts its next archive file.
ARCHIVE_BYTES = 8 << 20
#: Payloads below this are always stored in full.
REVISIT_BYTES = 100
BROADCAST_ROWS = 200_000

# fixed values: field lines of the ARC versions and the profile of WARC revisits
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADERS = {
    1: re.compile(rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,14}) (?P<mime>.*) (?P<length>\d+)"),
    2: re.compile(
        rb"(?P<url>.*) (?P<ip>\S+) (?P<date>\d{12,14}) (?P<mime>.*) (?P<code>\S+) (?P<checksum>\S+) "
        rb"(?P<location>\S+) (?P<offset>\d+) (?P<filename>\S+) (?P<length>\d+)"
    ),
}
_MANIFEST = "path string, records long, bytes long"


class ArchiveWriter:
    """Archive files of one task, one gzip member per record."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.fs, self.folder = arrow_fs.FileSystem.from_uri(folder)
        self.suffix, self.number = suffix, 0
        self.task, self.attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        self.done: list[tuple[str, int, int]] = []
        self._open()

    def _open(self) -> None:
        self.data, self.records, self.size = io.BytesIO(), 0, 0

    @property
    def name(self) -> str:
        return f"part-{self.task:06d}-{self.number:05d}.{self.suffix}"

    def add(self, record: bytes) -> None:
        self.data.write(gzip.compress(record, 6, mtime=0))
        self.records += 1
        self.size += len(record)

    @property
    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES

    def close(self) -> None:
        """Put the file in place; readers ignore names that begin with an underscore."""
        if self.records:
            temporary = f"{self.folder}/_{self.attempt}-{self.name}"
            with self.fs.open_output_stream(temporary, compression=None) as out:
                out.write(self.data.getbuffer())
            self.fs.move(temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.records, self.data.tell()))
            self.number += 1
        self._open()

    def manifest(self) -> pa.RecordBatch:
        rows = list(zip(*self.done)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(rows, kinds)], names=["path", "records", "bytes"])


def _folder(spark: SparkSession, name: str) -> str:
    path = work_path(spark, name)
    fs, local = arrow_fs.FileSystem.from_uri(path)
    fs.create_dir(local)
    return path


def unpacked(data: bytes) -> bytes:
    """Plain bytes of a file that may consist of gzip members.

    Input goes in by short pieces: what is left of a piece after the end of a member
    is copied, and a file has very many members.
    """
    if data[:2] != b"\x1f\x8b":
        return data
    out, view, at = [], memoryview(data), 0
    member = zlib.decompressobj(31)
    while at < len(data):
        piece = view[at : at + (1 << 14)]
        out.append(member.decompress(piece))
        at += len(piece) - len(member.unused_data)
        if member.eof:
            member = zlib.decompressobj(31)
            while at < len(data) and data[at] == 0:  # padding
                at += 1
    return b"".join(out)


# ---- ARC


def arc_file_head(name: str, version: int, date: str) -> bytes:
    """Version block of an ARC file."""
    body = f"{version} 0 legacy\n{ARC_FIELDS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(body)}\n".encode() + body


def arc_record(url: str, date: str, body: bytes, version: int, offset: int, name: str) -> bytes:
    head = f"{url} 0.0.0.0 {date} text/html "
    if version == 2:
        head += f"200 {hashlib.md5(body).hexdigest()} - {offset} {name} "
    return f"\n{head}{len(body)}\n".encode() + body


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, plain or in gzip members.

    The version block, which only the first record of a file can be (``info``), decides how
    header lines are split; a line that does not fit is skipped up to the next one that
    does. A body shorter than declared is ``truncated``.
    """
    data = unpacked(data)
    at, version, first = 0, 1, True
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        info = first and line.startswith(b"filedesc:")
        head = (_HEADERS[2].fullmatch(line) or _HEADERS[1].fullmatch(line)) if info else _HEADERS[version].fullmatch(line)
        if not line or not head:
            at = end + 1
            continue
        size = int(head["length"])
        body = data[end + 1 : end + 1 + size]
        record = {k: head[k].decode("utf-8", "replace") for k in ("url", "ip", "date", "mime")}
        if info:
            version = 2 if body.startswith(b"2") else 1
        yield record | {"body": body, "offset": at, "truncated": len(body) < size, "version": version, "info": info}
        at, first = end + 1 + size, False


def _arc_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = ArchiveWriter(folder, "arc.gz")
    version, offset = 1 + out.task % 2, 0
    for batch in batches:
        for key, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
            key, payload = key.as_py(), (html.as_py() or "").encode("utf-8", "replace")
            date = datetime.fromtimestamp(946_684_800 + (key or 0) % 631_152_000).strftime("%Y%m%d%H%M%S")
            if out.full:
                out.close()
            if not out.records:
                version, offset = 1 + out.number % 2, 0
                out.add(arc_file_head(out.name, version, date))
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            if key is not None:
                http += b"X-Page-Id: %d\r\n" % key
            body = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
            target = quote(url.as_py() or f"urn:page:{key}", safe="/:?#[]@!$&'()*+,;=%~")
            out.add(arc_record(target, date, body, version, out.size, out.name))
    out.close()
    yield out.manifest()


def write_arc(pages: DataFrame) -> tuple[str, DataFrame]:
    """Archive ``pages(page_id, url, html)`` as ARC files of both versions; returns folder and manifest.

    A null html is an empty payload, a null url becomes ``urn:page:<id>``.
    """
    folder = _folder(pages.sparkSession, "arc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return folder, stored(rows.mapInArrow(lambda it: _arc_files(it, folder), _MANIFEST), "arc-manifest")


# ---- conversion


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; no head when the body is not HTTP."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def _http_int(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"\r\n" + name + rb": *(-?\d+)\r\n", head)
    return int(found[1]) if found else None


def _iso(date: str) -> str:
    try:
        return datetime.strptime(date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(file: str, offset: int, url: str, date: str) -> str:
    """Stable WARC id of a record that has none."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{offset} {date} {url}").urn


_CONVERTED = (
    "file string, offset long, key long, id string, url string, ip string, date string, mime string, "
    "version int, truncated boolean, head binary, payload binary, digest string, n_bytes long, info boolean"
)


def _converted(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CONVERTED.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in _CONVERTED.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            file, rows, held = path.as_py().rsplit("/", 1)[-1], [], 0
            for r in parse_arc(content.as_py()):
                head, payload = _split_http(r["body"])
                rows.append(
                    (file, r["offset"], _http_int(head, b"X-Page-Id"), record_id(file, r["offset"], r["url"], r["date"]), r["url"], r["ip"],
                     _iso(r["date"]), r["mime"], r["version"], r["truncated"], head if payloads else b"", payload if payloads else b"",
                     hashlib.sha256(payload).hexdigest(), len(payload), r["info"])
                )
                held += len(payload)
                if held >= ARCHIVE_BYTES or len(rows) >= 4096:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def _files(spark: SparkSession, folder: str, manifest: DataFrame | None) -> DataFrame:
    """Archive files of a folder, or only those of its manifest.

    A lost task is run again and may come to other files; the manifest has what the task
    that counted wrote. Spark lists as many paths on the driver when it reads a folder.
    """
    paths = folder if manifest is None else [f"{folder}/{r['path']}" for r in manifest.select("path").collect()]
    return spark.read.format("binaryFile").load(paths)


def arc_records(spark: SparkSession, folder: str, payloads: bool = True, manifest: DataFrame | None = None) -> DataFrame:
    """Parsed records of all ARC files below ``folder``, or of its ``manifest``, with synthesised WARC fields."""
    files = _files(spark, folder, manifest).select("path", "content")
    return files.mapInArrow(lambda it: _converted(it, payloads), _CONVERTED)


def _fields(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_record(r: dict) -> bytes:
    """One WARC record; ``first`` names the response that a revisit refers to."""
    first = r["first"]
    fields: list[tuple[str, object]] = [("WARC-Record-ID", f"<{r['id']}>"), ("WARC-Date", r["date"])]
    if r["info"]:
        fields += [("WARC-Filename", r["file"]), ("Content-Type", "application/warc-fields")]
        return _fields("warcinfo", fields, f"software: legacy archive converter\r\nsource-format: ARC version {r['version']}\r\n".encode())
    fields += [
        ("WARC-Target-URI", r["url"]),
        ("WARC-IP-Address", r["ip"] if r["ip"] != "0.0.0.0" else None),
        ("WARC-Payload-Digest", f"sha256:{r['digest']}"),
        ("X-Source-Key", r["key"]),
        ("WARC-Truncated", "length" if r["truncated"] else None),
    ]
    if first is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<{first['id']}>"),
            ("WARC-Refers-To-Target-URI", first["url"]),
            ("WARC-Refers-To-Date", first["date"]),
            ("X-Refers-To-Key", first["key"]),
            ("X-Payload-Length", r["n_bytes"]),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return _fields("revisit", fields, r["head"])
    block = r["head"] + r["payload"]
    fields += [
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"]),
    ]
    return _fields("response" if r["head"] else "resource", fields, block)


def _warc_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out = ArchiveWriter(folder, "warc.gz")
    for batch in batches:
        for i in range(batch.num_rows):
            if out.full:
                out.close()
            out.add(warc_record({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
    out.close()
    yield out.manifest()


def convert(
    spark: SparkSession, arc_folder: str, revisit_bytes: int = REVISIT_BYTES, arc_manifest: DataFrame | None = None
) -> tuple[str, DataFrame]:
    """Convert the ARC files of a folder or its manifest to WARC files; returns their folder and the manifest.

    Of records with equal payloads of at least ``revisit_bytes`` the one with the
    smallest key is the response; ties and missing keys follow file and offset.
    """
    first_of = F.struct(
        F.col("key").isNull().alias("no_key"), "key", "file", "offset", "id", "url", "date"
    )
    firsts = (
        arc_records(spark, arc_folder, False, arc_manifest)
        .where((F.col("n_bytes") >= revisit_bytes) & ~F.col("info"))
        .groupBy("digest")
        .agg(F.min(first_of).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    firsts = stored(firsts, "firsts")
    known = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    records = arc_records(spark, arc_folder, True, arc_manifest)
    joined = records.join(known, "digest", "left")
    itself = (F.col("first.file") == F.col("file")) & (F.col("first.offset") == F.col("offset"))
    refers = (F.col("n_bytes") >= revisit_bytes) & ~F.col("info") & F.col("first").isNotNull() & ~itself
    rows = joined.withColumn("first", F.when(refers, F.col("first")))
    rows = rows.withColumn("payload", F.when(refers, F.lit(b"")).otherwise(F.col("payload")))
    folder = _folder(spark, "warc")
    return folder, stored(rows.mapInArrow(lambda it: _warc_files(it, folder), _MANIFEST), "warc-manifest")


# ---- reading back


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a WARC file, plain or in gzip members."""
    data, at = unpacked(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


_READ = "key long, record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, valid boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_warc(content.as_py()):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                key, told = fields.get("X-Source-Key"), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "revisit":
                    size, digest = int(fields["X-Payload-Length"]), told
                else:
                    payload = _split_http(block)[1]
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                refers = fields.get("X-Refers-To-Key")
                rows.append(
                    (int(key) if key else None, fields["WARC-Record-ID"].strip("<>"), fields["WARC-Target-URI"], fields["WARC-Date"],
                     kind, size, digest, int(refers) if refers else None, digest == told)
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of all WARC files of a folder or its manifest; ``valid`` tells whether a stored payload has its stated digest."""
    return _files(spark, folder, manifest).select("content").mapInArrow(_read, _READ)


def archive_pages(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archive ``pages`` as ARC, convert to WARC and read that back: one row per row of ``pages``.

    Repeated page_ids give a record each; a null page_id comes back null and counts
    as larger than any other. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    arc, written = write_arc(pages)
    if written.count() == 0:
        return spark.createDataFrame([], _READ)
    warc, converted = convert(spark, arc, revisit_bytes, written)
    return read_warc(spark, warc, converted)
