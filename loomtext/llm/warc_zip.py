"""WARC records in ZIP-packaged archives: a writer, and a reader that never extracts.

Method: the reader parses the end-of-central-directory record (and its ZIP64
form), then the central directory, locates the stored members that hold the
archive and its index, reads the index, and range-reads single records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import store

#: Fixed values of the ZIP format: record signatures, and the markers that send a reader to the ZIP64 fields.
END_SIG, LOCATOR64_SIG, END64_SIG, CENTRAL_SIG, LOCAL_SIG = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Members of an archive.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads from this many bytes may be revisited; an archive is closed at about so many bytes.
LEAST, CLOSE_AT = 100, 32 << 20


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


class Archive:
    """A ZIP archive behind ``read_at(offset, length)``; nothing is read but what is asked for."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self._directory()}

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read_at(tail_at, self.size - tail_at)
        at = tail.rfind(END_SIG)
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(END_SIG, 0, at)  # the signature may stand in a comment
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP archive, or a truncated one")
        entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == entries or FULL32 in (size, offset):
            locator = self.read_at(tail_at + at - 20, 20)
            if locator[:4] != LOCATOR64_SIG:
                raise ValueError("ZIP64 locator is missing")
            end = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != END64_SIG:
                raise ValueError("ZIP64 end of central directory is missing")
            entries, size, offset = struct.unpack_from("<QQQ", end, 32)
        return entries, size, offset

    def _directory(self) -> Iterator[Member]:
        entries, size, offset = self._end()
        raw, at = self.read_at(offset, size), 0
        for _ in range(entries):
            if raw[at : at + 4] != CENTRAL_SIG:
                raise ValueError("bad central directory entry")
            method, = struct.unpack_from("<H", raw, at + 10)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            full, packed, header = wide_fields(extra, full, packed, header)
            yield Member(name, method, full, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed; ranges of it cannot be read")
        local = self.read_at(m.header, 30)
        if local[:4] != LOCAL_SIG:
            raise ValueError(f"bad local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        m = self.members[name]
        length = m.size - offset if length is None else length
        if offset < 0 or offset + length > m.size:
            raise ValueError(f"range {offset}+{length} is outside {name}")
        return self.read_at(self.start(name) + offset, length)


def wide_fields(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset with those that are full taken from the ZIP64 extra field, in the order of the format."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide) if v == FULL32 else v for v in values]
        at += 4 + n
    return list(values)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record, gzip member and all. A revisit holds the HTTP header without the payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    clean = "".join(c for c in url or "" if c >= " ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {clean}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of a record: type, page_id, digest, bytes, refers_to, url, payload (none for a revisit)."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    ident = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"record_type": kind, "page_id": ident(fields["WARC-Record-ID"]), "payload_digest": digest, "payload_bytes": sizes[0], "refers_to": ident(fields.get("WARC-Refers-To")), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def build(records: list[tuple[str, bytes]]) -> bytes:
    """An archive of records (index key, bytes): data and index as stored members."""
    index, at = [], 0
    for key, raw in records:
        index.append(f"{key} 20000101000000 {json.dumps({'offset': at, 'length': len(raw), 'filename': 'data.warc.gz'})}")
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(raw for _, raw in records)), (INDEX, "\n".join(index).encode()), ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def opened(path: str):
    """A random-access file by URI or plain path."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, inner


def read_archive(path: str) -> tuple[Archive, object]:
    fs, inner = opened(path)
    handle = fs.open_input_file(inner)
    return Archive(lambda at, n: handle.read_at(n, at), handle.size()), handle


def plan(pages: DataFrame) -> DataFrame:
    """Add digest, bytes and refers_to to pages (page_id, url, html). Null html is empty.

    Of records with equal payloads of at least LEAST bytes the smallest page_id
    is the response; rows that repeat it are responses too. A null page_id
    refers to the response if there is one.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = store.join_small(rows, store.table(firsts, "firsts"), "digest")
    return joined.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first"))).drop("first")


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write archives into ``folder``; a stored row (path, records) for each.

    A task that is run again writes archives of new names; only those of the
    committed attempt are in the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(records: list) -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            fs, inner = opened(path)
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(inner) as out:
                out.write(build(records))
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(records)]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

        held, size = [], 0
        for b in batches:
            for r in range(b.num_rows):
                page, url, html, digest, refers = (b.column(c)[r].as_py() for c in ("page_id", "url", "html", "digest", "refers_to"))
                raw = record(page, url, html.encode(), digest, refers)
                held.append((f"urn:page:{'' if page is None else page}", raw))
                size += len(raw)
                if size >= CLOSE_AT:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    return store.table(planned.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records bigint"), "archives")


def locate(paths: DataFrame) -> DataFrame:
    """Every record of the archives: path, offset and length in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                archive, handle = read_archive(path)
                with handle:
                    first = archive.start(DATA)
                    found = [json.loads(x.split(" ", 2)[2]) for x in archive.read(INDEX).decode().splitlines()]
                yield pa.RecordBatch.from_pydict({"path": [path] * len(found), "offset": [first + x["offset"] for x in found], "length": [x["length"] for x in found]}, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    spread = paths.select("path").repartition(store.partitions(paths.sparkSession))
    return spread.mapInArrow(run, "path string, offset bigint, length bigint")


def records(located: DataFrame, payload: bool = False) -> DataFrame:
    """Range-read located records: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload)."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + [("payload", pa.binary())] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, at, handle = [], None, None
            for path, offset, length in sorted(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")))):
                if path != at:
                    if handle:
                        handle.close()
                    fs, inner = opened(path)
                    at, handle = path, fs.open_input_file(inner)
                out.append(parse(handle.read_at(length, offset)))
            if handle:
                handle.close()
            yield pa.RecordBatch.from_pydict({k: [x[k] for x in out] for k, _ in fields}, pa.schema(fields))

    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payload
    n = store.partitions(located.sparkSession)
    return located.repartition(n, "path", F.shiftright("offset", 22)).mapInArrow(run, kinds)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) into archives in the shared folder and read all records back.

    ``page_id`` is a whole number; a null url is the empty one, a null html an empty payload. Pages of any length are
    written whole. Of equal payloads the smallest page_id is the response; repeated rows give repeated records. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    made = write(plan(pages), store.new_path(spark, "wacz"))
    return records(locate(made))


#: The same in DuckDB's SQL.
ORACLE = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f
"""
