"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Writing. Every row becomes a record: a response that carries the page, or, for a payload of some size that another row
has too, a revisit that names the response. Records are gzip members of their own, archives are closed at a bounded
size. A task writes under a name of its own attempt, and only archives listed in the manifest (a table that Spark
commits) count, so what a lost or repeated task left behind is never read.

Reading. A record is believed when its member inflates with the right checksum, its version line and length fit, and
its payload has the digest it names. Where that fails the reader goes on, byte by byte, to the next gzip member or
version line that passes, and reports the bytes between as a gap, with the reason of the first failure.

Archives are written to and read from the folder in spark.checkpoint.dir, through pyarrow's file systems.

Defined cases: a null page is empty; rows without page_id count as the smallest id; rows that repeat id and payload are
responses if they hold the largest id; a file without any record is one gap; an empty table gives no archive and an
empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feltmill.session import scratch_path, stored

ARCHIVE_BYTES = 32 << 20
SHARED_FROM = 1000
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"
NO_ID = -(2**63)
_CHUNK = 1 << 18
_HEAD = 1 << 16


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit keeps the payload's HTTP headers, its length among them, and its digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    heads = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n"), "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        heads |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    heads |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in heads.items()).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filesystem(folder: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, shared_from: int = SHARED_FROM, archive_bytes: int = ARCHIVE_BYTES, compressed: bool = True) -> DataFrame:
    """Writes the archives of (page_id, url, html) rows; gives their manifest (archive, n_records, n_bytes)."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"__digest": F.sha1(F.encode("html", "UTF-8")), "__id": F.coalesce("page_id", F.lit(NO_ID))})
    keys = own.filter(F.octet_length("html") >= shared_from).select("__id", "__digest")
    largest = keys.groupBy("__digest").agg(F.max("__id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    again = stored(keys.join(largest, "__digest").filter("__id < __first").distinct(), "revisits")
    rows = own.join(again, ["__id", "__digest"], "left").select("page_id", "url", "html", "__first")
    suffix = ".warc.gz" if compressed else ".warc"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        out, path, count, size = None, "", 0, 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["archive", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, page, first in zip(*batch.columns, strict=True):
                if out is None:
                    store.create_dir(root)
                    path, count, size = f"{uuid.uuid4().hex}{suffix}", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                first = first.as_py()
                whole = record(page_id.as_py(), url.as_py(), page.as_py().encode(), None if first == NO_ID else first, first is not None)
                whole = member(whole) if compressed else whole
                out.write(whole)
                count, size = count + 1, size + len(whole)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield listed()
        if out is not None:
            out.close()
            yield listed()

    manifest = stored(rows.mapInArrow(write, "archive string, n_records long, n_bytes long"), "warc-manifest")
    return manifest.withColumn("archive", F.concat(F.lit(f"{folder}/"), "archive"))


class _Bytes:
    """Random access to a file through one buffer."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, _CHUNK))
        return self.held[at - self.at : at - self.at + n]


@dataclass
class Record:
    at: int
    end: int
    heads: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    trouble: str = ""  # why the bytes are no record; then end is unknown

    def http(self) -> tuple[dict[str, str], bytes]:
        """(HTTP headers, payload) of a response or revisit; other records have their block as payload."""
        if "application/http" not in self.heads.get("content-type", ""):
            return {}, self.block
        top, _, payload = self.block.partition(b"\r\n\r\n")
        return _fields(top), payload


def _fields(top: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in top.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


def _checked(found: Record) -> Record:
    named = found.heads.get("warc-payload-digest", "")
    if found.heads.get("warc-type") == "response" and named.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(found.http()[1]).digest()).decode() != named[5:]:
            found.trouble = "payload digest differs"
    return found


def _open_record(data: _Bytes, at: int) -> Record:
    """An uncompressed record that begins at `at`."""
    n = _HEAD
    head = data.get(at, n)
    cut = head.find(b"\r\n\r\n")
    while cut < 0 and at + n < data.size and head.startswith(b"WARC/1."):
        n *= 2
        head = data.get(at, n)
        cut = head.find(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or cut < 0:
        return Record(at, at, trouble="no version line" if cut >= 0 else "headers do not end")
    heads = _fields(head[:cut])
    if not {"warc-type", "warc-record-id", "warc-date"} <= heads.keys():
        return Record(at, at, trouble="a mandatory field is missing")
    length = heads.get("content-length", "")
    if not length.isdigit():
        return Record(at, at, trouble="no content length")
    begin, n = at + cut + 4, int(length)
    if begin + n + 4 > data.size:
        return Record(at, at, trouble="record is cut off")
    if data.get(begin + n, 4) != b"\r\n\r\n":
        return Record(at, at, trouble="record does not end where it says")
    return _checked(Record(at, begin + n + 4, heads, data.get(begin, n)))


def _member_record(data: _Bytes, at: int) -> Record:
    """A record in a gzip member that begins at `at`."""
    opener, parts, place = zlib.decompressobj(31), [], at
    try:
        while not opener.eof:
            piece = data.get(place, min(_CHUNK, data.size - place))
            if not piece:
                return Record(at, at, trouble="member is cut off")
            parts.append(opener.decompress(piece))
            place += len(piece)
    except zlib.error:
        return Record(at, at, trouble="member does not inflate")
    whole = b"".join(parts)
    end = place - len(opener.unused_data)
    inner = _open_record(_Bytes(pa.BufferReader(whole)), 0)
    if not inner.trouble and inner.end != len(whole):
        inner.trouble = "member holds more than a record"
    return Record(at, end, inner.heads, inner.block, inner.trouble)


def _record_at(data: _Bytes, at: int) -> Record:
    return _member_record(data, at) if data.get(at, 3) == MEMBER else _open_record(data, at)


def _next_start(data: _Bytes, at: int) -> int:
    """Where the next gzip member or version line might begin, from `at` on."""
    while at < data.size:
        piece = data.get(at, min(_CHUNK, data.size - at))
        places = [p for p in (piece.find(MEMBER), piece.find(b"WARC/1.")) if p >= 0]
        if places:
            return at + min(places)
        if at + len(piece) >= data.size:
            break
        at += len(piece) - 6
    return data.size


def salvage(file: pa.NativeFile) -> Iterator[Record]:
    """Every record that passes its checks; between them, gaps: records with `trouble` and their whole extent."""
    data, at = _Bytes(file), 0
    gap: Record | None = None
    while at < data.size:
        found = _record_at(data, at)
        if not found.trouble:
            if gap:
                gap.end = at
                yield gap
                gap = None
            yield found
            at = found.end
            continue
        gap = gap or Record(at, at, trouble=found.trouble)
        at = _next_start(data, at + 1)
    if gap:
        gap.end = data.size
        yield gap


def without_gaps(found: DataFrame) -> DataFrame:
    """The records of archives that must be whole; the job fails if there is a gap."""
    told = F.concat(F.lit("gap in "), "archive", F.lit(" at byte "), F.col("at").cast("string"), F.lit(": "), "trouble")
    return found.filter(F.when(F.col("trouble").isNull(), True).otherwise(F.raise_error(told).cast("boolean")))


READ = (
    "archive string, at long, n_bytes long, trouble string, record_type string, record_id string, url string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files named in column `archive`. Gaps have `trouble`; records have all else.

    payload_bytes and payload_digest (hex) speak of the full payload: measured for responses, as told by the record for
    revisits. One file is read by one task, through a buffer.
    """
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def row(name: str, found: Record) -> tuple:
        if found.trouble:
            return (name, found.at, found.end - found.at, found.trouble, *[None] * 7)
        http, payload = found.http()
        heads, revisit = found.heads, found.heads.get("warc-type") == "revisit"
        told = heads.get("warc-payload-digest", "").removeprefix("sha1:")
        digest = base64.b32decode(told).hex() if revisit and len(told) == 32 else None if revisit else hashlib.sha1(payload).hexdigest()
        size = http.get("content-length", "") if revisit else str(len(payload))
        return (
            name, found.at, found.end - found.at, None, heads.get("warc-type"), heads.get("warc-record-id"), heads.get("warc-target-uri"),
            heads.get("warc-refers-to"), int(size) if size.isdigit() else None, digest, payload if with_payload and not revisit else None,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _filesystem(name)
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for found in salvage(file):
                        rows.append(row(name, found))
                        held += len(rows[-1][-1] or b"")
                        if len(rows) >= 1000 or held >= 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return archives.select("archive").repartition("archive").mapInArrow(read, READ)
