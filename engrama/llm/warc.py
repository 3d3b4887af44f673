"""WARC archives as a Spark data source in Python.

Writing: one gzip member per record, each with the skip lengths in its header, in
files that a manifest names once all tasks are done. Reading: any WARC files, be
their gzip members one per record (with skip lengths or without), one per
file, or none at all. Large files of one member per record are divided by bytes. A
record's headers are decoded first, and its payload only if the pushed
predicates hold and the payload is asked for; else the reader seeks to the next
record where it knows its place, and inflates to nothing where it doesn't.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from engrama.llm.shared import materialise

FORMAT = "engrama_warc"
MANIFEST = "_manifest.json"
SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Payloads under so many bytes are never revisits.
SMALL = 100
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
#: Bytes of a partition's share of a file, of a read, and of the longest block of headers that is taken for one.
SPLIT, STEP, HEADERS = 64 << 20, 1 << 16, 1 << 20
#: Rows of a batch that is handed to Spark, and their payload bytes.
ROWS, BYTES = 1000, 8 << 20


def _fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; Hadoop's names for S3 mean S3."""
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """A header value on one line; what can't stand there is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _restore(value: str) -> str:
    if "%" not in value:
        return value
    head, *parts = value.split("%")
    return head + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode_record(kind: str, page_id: int | None, url: str | None, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record as a gzip member of its own."""
    block = HTTP + payload if kind == "response" else HTTP
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _clean(url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head += [("X-Payload-Length", str(size)), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    whole = len(GZIP) + 14 + len(body) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, whole, len(raw) & 0xFFFFFFFF)
    return GZIP + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Part(InputPartition):
    """The records whose start lies between two bytes of a file."""

    def __init__(self, path: str, start: int = 0, end: int = 1 << 62):
        self.value, self.start, self.end = path, start, end


class Done(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, base = _fs(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for b in iterator:
            for row in zip(*(b.column(c).to_pylist() for c in ("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(encode_record(*row[:6], row[6] or b""))
        if out is None:
            return Done(None)
        out.close()
        return Done(name)

    def commit(self, messages: list[Done | None]) -> None:
        """A manifest of this write's files, moved into place whole. Files of tasks that ran twice or failed stay out of it and so out of every read."""
        store, base = _fs(self.path)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}{MANIFEST}"
        with store.open_output_stream(f"{base}/.{name}", compression=None) as f:
            f.write(json.dumps(sorted(m.name for m in messages if m is not None and m.name)).encode())
        store.move(f"{base}/.{name}", f"{base}/{name}")

    def abort(self, messages: list[Done | None]) -> None:
        store, base = _fs(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{base}/{m.name}")


def _files(path: str) -> list[tuple[str, int]]:
    """Files to read and their sizes: the path itself, or what the manifests in it name, or, without any, all archives in it."""
    store, base = _fs(path)
    at = store.get_file_info(base)
    if at.type == fs.FileType.File:
        return [(path, at.size)]
    if at.type == fs.FileType.NotFound:
        return []
    inside = {x.base_name: x.size for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))}
    manifests = [n for n in inside if n.endswith(MANIFEST)]
    names = [n for n in inside if n.endswith((".warc", ".warc.gz"))]
    if manifests:
        names = []
        for m in manifests:
            with store.open_input_stream(f"{base}/{m}", compression=None) as f:
                names += json.loads(f.read())
    return [(f"{path}/{n}", inside[n]) for n in sorted(names)]


class Bytes:
    """The text of an archive from a byte on: read() and skip() over its decompressed bytes, one gzip member after the other."""

    def __init__(self, f: pa.NativeFile, at: int, packed: bool):
        self.f, self.packed, self.held, self.raw = f, packed, b"", b""
        self.member = at  #: where the member of the next byte starts
        self.inflate = zlib.decompressobj(31) if packed else None
        self.next = at  #: of the next read
        f.seek(at)

    def more(self, most: int = STEP) -> bool:
        """Holds more bytes, or says that there are none in this member."""
        if not self.packed:
            chunk = self.f.read(STEP)
            self.next += len(chunk)
            self.held += chunk
            return bool(chunk)
        while True:
            if self.inflate.eof:
                return False
            if not self.raw:
                self.raw = self.f.read(STEP)
                self.next += len(self.raw)
                if not self.raw:
                    return False
            got = self.inflate.decompress(self.raw, most)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True

    def next_member(self) -> bool:
        """Goes on to the next gzip member, if there is one."""
        if not (self.packed and self.inflate.eof):
            return False
        if not self.raw:
            self.raw = self.f.read(STEP)
            self.next += len(self.raw)
        if not self.raw:
            return False
        self.member = self.next - len(self.raw)
        self.inflate = zlib.decompressobj(31)
        return True

    def skip(self, n: int) -> None:
        """Leaves out n bytes without keeping them."""
        while n > len(self.held):
            n -= len(self.held)
            self.held = b""
            if not self.packed and n > STEP:
                self.next += n
                self.f.seek(self.next)
                return
            if not self.more():
                return
        self.held = self.held[n:]

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n and (self.held or self.more()):
            part = self.held[: n - got]
            self.held = self.held[len(part) :]
            parts.append(part)
            got += len(part)
        if got < n:
            raise ValueError(f"a record cut short in the member at byte {self.member}")
        return b"".join(parts)


class Reader(DataSourceReader):
    """Options: path; payload ("true", or "false" to leave every payload undecoded); split (bytes of a file per partition, about)."""

    HEADERS = ("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes")

    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split", SPLIT))
        self.checks: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "eq", In: "in", IsNotNull: "set", StringStartsWith: "starts"}.get(type(f))
            if name in self.HEADERS and kind:
                self.checks.append((kind, name, set(f.value) if kind == "in" else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        parts = []
        for path, size in _files(self.path):
            step = self.split if path.endswith(".gz") else max(size, 1)  # without members there is no sure place to start at
            parts += [Part(path, at, at + step) for at in range(0, max(size, 1), step)]
        return parts or [Part("")]

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.checks:
            have = row[name]
            if have is None or (kind == "eq" and have != value) or (kind == "in" and have not in value) or (kind == "starts" and not have.startswith(value)):
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        if not partition.value:
            return
        store, name = _fs(partition.value)
        rows, held = [], 0
        with store.open_input_file(name) as f:
            for row in self.records(f, partition.start, partition.end):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= ROWS or held >= BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, f: pa.NativeFile, start: int = 0, end: int = 1 << 62) -> Iterator[dict]:
        """Records of the members that start between two bytes; of files without members, all."""
        size = f.size()
        f.seek(0)
        packed = f.read(2) == GZIP[:2]
        at = self.first_member(f, start, min(end, size)) if packed and start else start
        while at is not None and at < min(end, size):
            f.seek(at)
            head = f.read(24) if packed else b""
            if head[:4] == GZIP[:4] and head[12:14] == b"sl":
                whole, full = struct.unpack("<II", head[16:24])
                yield from self.own(f, at, whole, full)
                at += whole
            else:
                text = Bytes(f, at, packed)
                at = None
                while True:
                    yield from self.foreign(text)
                    if not text.next_member():
                        break
                    if text.member >= end:
                        return
                    if text.raw[12:14] == b"sl":
                        at = text.member
                        break

    @staticmethod
    def first_member(f: pa.NativeFile, start: int, end: int) -> int | None:
        """Where the first member at or after start begins whose text begins as a record does."""
        at, held = start, b""
        while at < end:
            f.seek(at)
            held = f.read(STEP + 4096)
            here = held.find(GZIP[:3])
            while 0 <= here < STEP:
                if at + here >= end:
                    return None
                try:
                    if zlib.decompressobj(31).decompress(held[here:], 5) == b"WARC/":
                        return at + here
                except zlib.error:
                    pass
                here = held.find(GZIP[:3], here + 1)
            at += STEP
        return None

    def own(self, f: pa.NativeFile, at: int, whole: int, full: int) -> Iterator[dict]:
        """The record of a member that says how long it is."""
        inflate = zlib.decompressobj(-15)
        raw, read, step = b"", 24, min(whole - 32, 1024)
        while (end := raw.find(b"\r\n\r\n")) < 0:  # headers first
            chunk = f.read(min(step, whole - 8 - read))  # never beyond the member's own deflated bytes
            read += len(chunk)
            if not chunk:
                raise ValueError(f"a record without end of headers at byte {at}")
            raw += inflate.decompress(chunk)
        row, length, http = self.head(raw[:end])
        if not self.wanted(row):
            return
        if self.payload and row["record_type"] == "response":
            raw += inflate.decompress(f.read(whole - 8 - read)) + inflate.flush()
            if len(raw) & 0xFFFFFFFF != full:
                raise ValueError(f"a damaged record at byte {at}")
            self.fill(row, raw[end + 4 : end + 4 + length], http)
        yield row

    def foreign(self, text: Bytes) -> Iterator[dict]:
        """The records of a member, or of a file without any, in the order of their bytes."""
        while True:
            while True:  # line ends before a record
                text.held = text.held.lstrip(b"\r\n")
                if text.held or not text.more(1024):
                    break
            if not text.held:
                return
            while (end := text.held.find(b"\r\n\r\n")) < 0:
                if len(text.held) > HEADERS or not text.more(1024):
                    raise ValueError(f"a record without end of headers in the member at byte {text.member}")
            row, length, http = self.head(text.held[:end])
            text.held = text.held[end + 4 :]
            if not self.wanted(row):
                text.skip(length)
                continue
            if self.payload and row["record_type"] == "response":
                self.fill(row, text.take(length), http)
            else:
                text.skip(length)
            yield row

    @staticmethod
    def fill(row: dict, block: bytes, http: bool) -> None:
        row["payload"] = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else block
        if row["payload_bytes"] is None:
            row["payload_bytes"] = len(row["payload"])

    @staticmethod
    def head(raw: bytes) -> tuple[dict, int, bool]:
        """A record's row without payload, the length of its block, and whether that is an HTTP message. Header names have no case; lines that begin with a blank go on from the one before."""
        first, *lines = raw.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins with {first[:20]!r}")
        h: dict[str, str] = {}
        name = ""
        for line in lines:
            if line[:1] in (" ", "\t") and name:
                h[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                h[name := name.strip().lower()] = value.strip()
        number = lambda k: int(v) if (v := h.get(k, "")).isdecimal() or v[:1] == "-" and v[1:].isdecimal() else None
        url = h.get("warc-target-uri")
        if url is not None:
            url = _restore(url) if "x-payload-length" in h else url.removeprefix("<").removesuffix(">")
        digest = h.get("warc-payload-digest")
        row = {"record_type": h.get("warc-type"), "page_id": number("x-page-id"), "url": url, "refers_to": number("x-refers-to-page"),
               "payload_digest": digest and digest.removeprefix("sha256:"), "payload_bytes": number("x-payload-length"), "payload": None}
        return row, number("content-length") or 0, h.get("content-type", "").startswith("application/http")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, small: int = SMALL, broadcast_rows: int = 1_000_000) -> DataFrame:
    """A record per row of pages (page_id, url, html), in SCHEMA.

    Of rows with equal payloads of at least `small` bytes, those with the
    smallest page_id are responses and the others revisits that refer to it; a row without page_id
    is a revisit if another has one. Null html is an empty payload. Payloads
    of revisits are dropped; repeated rows with the smallest page_id are all responses; columns other than the three are not read,
    and an empty table gives no records. Digests are grouped first; only groups of
    several page ids join back, by broadcast up to broadcast_rows.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    seen = seen.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = seen.where(F.col("payload_bytes") >= small).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialise(groups.where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "payloads")
    groups = F.broadcast(groups) if groups.count() <= broadcast_rows else groups
    out = seen.join(groups, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "url",
        F.when(again, F.col("first")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, small: int = SMALL) -> None:
    register(pages.sparkSession)
    records(pages, small).write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, split: int = SPLIT) -> DataFrame:
    """Rows in SCHEMA, one per record of an archive or of a folder of them.

    Records of other writers have no page_id, and payload_bytes only where
    their payload was decoded. Payloads are those of response records, without their
    HTTP headers; all others are null. A folder without archives gives no rows, a damaged record is an error.
    """
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).option("split", str(split)).load(path)
