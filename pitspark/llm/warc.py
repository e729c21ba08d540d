"""WARC archives as a PySpark data source, with revisit records for repeated payloads.

Reading plans partitions over whole files, takes predicates on the record type and on header fields, and parses each
record's headers first; the payload of a record that no predicate lets through, or of any record when payloads are not
asked for, is skipped. Plain archives (.warc) and any gzip archives (.warc.gz) of the public standard are read, with records of
all types, in all folders below the path. Writing makes one gzip member per record; its extra field `sl` (compressed and full
length, as the standard's annex on compression has it) says where the next record starts, so that a payload is neither read nor inflated to be skipped.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import Scratch, delete_path, filesystem, new_path

SCHEMA = "page_id long, record_type string, target_uri string, record_id string, warc_date string, content_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Columns a predicate can be pushed down on: all but the payload.
HEADER_COLUMNS = ("page_id", "record_type", "target_uri", "record_id", "warc_date", "content_type", "refers_to", "payload_digest", "payload_bytes")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = struct.Struct("<4sIBBHccHII")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One record: WARC headers, HTTP headers, and for a response the payload. A revisit's HTTP headers keep the full length."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{uri}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if is_revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_field(uri)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page: {refers_to}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member with the extra field `sl`: its own length and the record's. A member of 4 GB or more, whose lengths the field cannot hold, has none."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = _HEAD.size + len(body) + 8
    if max(size, len(raw)) >= 1 << 32:
        return b"\x1f\x8b\x08\0" + struct.pack("<IBB", 0, 0, 255) + body + tail
    return _HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, size, len(raw)) + body + tail


class Damaged(ValueError):
    """The archive breaks the format here."""


def _lengths(head: bytes) -> int | None:
    """The member's length by its extra field `sl`, if it has one that begins there."""
    if len(head) < _HEAD.size or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    _, _, _, _, _, s, l, _, size, _ = _HEAD.unpack(head[: _HEAD.size])
    return size if s + l == b"sl" else None


class _Inflated:
    """The bytes of a gzip file's members end to end, inflated as they are read."""

    def __init__(self, stream, stats: dict):
        self.stream, self.stats, self.inflate, self.ready, self.rest = stream, stats, None, b"", b""

    def fill(self, most: int) -> bool:
        """Inflates some bytes, about `most`, into `ready`, which is empty; False at the end of the file."""
        most = max(1024, min(most, 1 << 16))
        while True:
            if self.inflate is None or self.inflate.eof:
                self.rest = (self.inflate.unused_data if self.inflate else b"") or self.stream.read(max(4096, most))
                if not self.rest:
                    return False
                self.inflate = zlib.decompressobj(31)
            data = self.rest or self.stream.read(max(4096, most))
            if not data:
                raise Damaged("the archive ends within a member")
            self.ready = self.inflate.decompress(data, most)
            self.rest = self.inflate.unconsumed_tail
            if self.ready:
                self.stats["inflated"] = self.stats.get("inflated", 0) + len(self.ready)
                return True

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and (self.ready or self.fill(n)):
            out.append(self.ready[:n])
            self.ready, n = self.ready[n:], n - len(out[-1])
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.ready and not self.fill(n):
                raise Damaged("the archive ends within a record")
            took = min(n, len(self.ready))
            self.ready, n = self.ready[took:], n - took


class _Member(_Inflated):
    """A member of known length: what is skipped is left to the caller's seek."""

    def skip(self, n: int) -> None:
        pass


class _Plain:
    """A plain file; what is skipped is not read."""

    def __init__(self, stream, stats: dict):
        self.stream = stream

    def read(self, n: int) -> bytes:
        return self.stream.read(n)

    def skip(self, n: int) -> None:
        self.stream.seek(self.stream.tell() + n)


class _Buffered:
    """Headers come in pieces: bytes read too far are given back."""

    def __init__(self, source):
        self.source, self.held = source, b""

    def read(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out + self.source.read(n - len(out)) if len(out) < n else out

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        """Up to and with mark; all of `most` bytes, or what is left of the file, if it does not come."""
        out = self.held
        while mark not in out and (most is None or len(out) < most):
            more = self.source.read(1024)
            if not more:
                break
            out += more
        at = out.find(mark)
        end = len(out) if at < 0 else at + len(mark)
        end = end if most is None else min(end, most)
        self.held = out[end:]
        return out[:end]

    def skip(self, n: int) -> None:
        took = min(n, len(self.held))
        self.held = self.held[took:]
        if n > took:
            self.source.skip(n - took)


_END = b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """The fields of a record's head by lower-cased name; folded lines are joined."""
    lines = head.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _http(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("latin-1").split("\r\n")[1:])}


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def _one(source: _Buffered, wanted, payloads: bool) -> dict | None | bool:
    """The record that begins here; None if it is not wanted; False at the end of the file."""
    head = source.until(_END)
    while head.startswith(b"\r\n"):  # blank lines between records
        head = head[2:] or source.until(_END)
    if not head.strip():
        return False
    h = parse_headers(head)
    length = _number(h.get("content-length"))
    if length is None:
        raise Damaged("a record without a length")
    digest = h.get("warc-payload-digest", "")
    kind = h.get("warc-type")
    is_http = h.get("content-type", "").replace(" ", "").startswith("application/http")
    http_head = source.until(_END, length) if is_http else b""
    http = _http(http_head) if is_http else {}
    rest = length - len(http_head)
    # Of a revisit the block has no payload: its HTTP headers tell how long that is.
    r = {
        "page_id": _number(h.get("x-page-id")), "record_type": kind, "target_uri": h.get("warc-target-uri"), "record_id": h.get("warc-record-id"), "warc_date": h.get("warc-date"), "content_type": h.get("content-type"),
        "refers_to": _number(h.get("x-refers-to-page")), "payload_digest": digest.removeprefix("sha1:") or None, "payload_bytes": _number(http.get("content-length")) if kind == "revisit" else rest, "payload": None,
    }
    take = wanted(r)
    if take and payloads and kind != "revisit":
        r["payload"] = source.read(rest)
        if len(r["payload"]) < rest:
            raise Damaged("the archive ends within a record")
        if kind in ("response", "resource") and digest.startswith("sha1:") and "transfer-encoding" not in http and payload_digest(r["payload"]) != r["payload_digest"].upper():
            raise Damaged("payload and digest differ")
    else:
        source.skip(rest)
    return r if take else None


def records(stream, wanted=lambda h: True, payloads: bool = True, stats: dict | None = None) -> Iterator[dict]:
    """The wanted records of an archive, plain or gzip, in order; the stream can seek. stats counts `records` and `inflated` bytes.

    Members with the length field are left by a seek once their headers say that they are not wanted; others are inflated to
    their end. Payloads are as stored: chunked or coded HTTP bodies are not decoded.
    """
    stats = {} if stats is None else stats
    at = stream.tell()
    while head := stream.read(_HEAD.size):
        size = _lengths(head)
        stream.seek(at)
        if size is None:
            source = _Buffered(_Inflated(stream, stats) if head[:2] == b"\x1f\x8b" else _Plain(stream, stats))
            while (r := _one(source, wanted, payloads)) is not False:
                stats["records"] = stats.get("records", 0) + 1
                if r:
                    yield r
            return
        source = _Buffered(_Member(_Limited(stream, size), stats))
        r = _one(source, wanted, payloads)
        stats["records"] = stats.get("records", 0) + 1
        if r:
            if payloads and r["payload"] is not None:
                source.until(b"\0never")  # the end of the member, whose checksum zlib compares there
            yield r
        at += size
        stream.seek(at)


class _Limited:
    """The next `left` bytes of a stream, which may be read bit by bit."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left

    def read(self, n: int) -> bytes:
        got = self.stream.read(min(n, self.left))
        self.left -= len(got)
        return got


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.equal: dict[str, list] = {}

    def pushFilters(self, filters):
        """Takes equality, membership and not-null on header fields; hands back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and isinstance(f, (EqualTo, In)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.equal.setdefault(name, []).append(values)
            elif name in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.equal.setdefault(name, []).append(None)
            else:
                yield f

    def wanted(self, headers: dict) -> bool:
        return all(headers[k] is not None and all(v is None or headers[k] in v for v in tests) for k, tests in self.equal.items())

    def partitions(self):
        """Whole files of all folders, packed up to partitionBytes in order of their names; empty and hidden files fall away."""
        fs, root = filesystem(self.path)
        found = sorted((x.path, x.size) for x in fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)) if x.path.endswith((".warc.gz", ".warc")) and x.size and not x.path.rpartition("/")[2].startswith((".", "_")))
        packs: list[list] = []
        for name, size in found:
            if not packs or packs[-1][1] + size > self.partition_bytes:
                packs.append([[], 0])
            packs[-1][0].append(name)
            packs[-1][1] += size
        return [_Files(names) for names, _ in packs] or [_Files([])]

    def read(self, partition):
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for name in partition.paths:
            with fs.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 18) as stream:
                for r in records(stream, self.wanted, self.payloads):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) == 2048 or held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()), ("warc_date", pa.string()), ("content_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str], n: int):
        self.names, self.n = names, n


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date, self.write_id = options["path"], options.get("date", "2000-01-01T00:00:00Z"), uuid.uuid4().hex[:12]
        self.level, self.file_bytes = int(options.get("level", 1)), int(options.get("fileBytes", 64 << 20))

    def write(self, batches):
        """Rolls to a new file at fileBytes. Files bear the attempt's number and a hidden name until commit, which removes those of failed attempts."""
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, n, size = [], None, 0, 0
        context = TaskContext.get()
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "is_revisit")]
            for cells in zip(*columns):
                page_id, url, payload, refers_to, is_revisit = (c.as_py() for c in cells)
                if out is None:
                    names.append(f".part-{self.write_id}-{context.partitionId():05d}-{len(names):03d}-{context.taskAttemptId()}.tmp")
                    out = fs.open_output_stream(f"{root}/{names[-1]}")
                raw = member(record(page_id, url, payload or b"", refers_to, bool(is_revisit), self.date), self.level)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= self.file_bytes:
                    out.close()
                    out, size = None, 0
        if out is not None:
            out.close()
        return _Written(names, n)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{root}/{name}", f"{root}/{name[1:].rpartition('-')[0]}.warc.gz")
        self._sweep()

    def abort(self, messages):
        self._sweep()

    def _sweep(self) -> None:
        """Removes hidden files of this write: what attempts left that failed or came second."""
        fs, root = filesystem(self.path)
        for x in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if x.path.rpartition("/")[2].startswith(f".part-{self.write_id}-"):
                fs.delete_file(x.path)


class WarcDataSource(DataSource):
    """format("warc"): options path, payload (true), partitionBytes; for writing path, level, fileBytes, date."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, s: Scratch | None = None) -> DataFrame:
    """(page_id, url, payload, refers_to, is_revisit): of equal payloads of at least min_bytes the smallest id is the response.

    Payloads are equal if their SHA-256 is. A null html is an empty payload. Null ids come last; rows that repeat the
    response's id, payload and all are responses too, as nothing tells them apart. Only hashes of repeated payloads are
    shuffled apart from the pages themselves; AQE can split a payload that a third of the pages share.
    """
    s = s or Scratch(pages.sparkSession, "warc")
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = picked.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)))
    firsts = keyed.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    firsts = s.write(firsts.select("digest", "first", F.lit(True).alias("repeated")), "firsts", keep=True)
    later = F.coalesce(F.col("repeated") & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    joined = keyed.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(later, F.col("first")).alias("refers_to"), later.alias("is_revisit"))


def write_archives(pages: DataFrame, path: str | None = None, level: int = 1, file_bytes: int = 64 << 20, **columns) -> str:
    """Writes one record per page (see with_revisits for nulls and ties) and returns the folder. An empty table writes no file."""
    spark = pages.sparkSession
    register(spark)
    path = path or new_path(spark, "warc")
    s = Scratch(spark, "warc")
    try:
        with_revisits(pages, s=s, **columns).write.format("warc").mode("append").option("path", path).option("level", level).option("fileBytes", file_bytes).save()
    finally:
        delete_path(spark, s.root)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records of all archives in the folder. Load once per query: Spark keeps a predicate that it pushed with the loaded frame."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("partitionBytes", partition_bytes).load()
