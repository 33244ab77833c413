"""WARC archives as a Spark data source, and deduplicated writing of pages.

``register(spark)`` adds the format ``warc``:

* Reading plans partitions from the files: small ones share a partition, a
  large one has its own. Predicates on the header columns are pushed down; a
  record's headers are parsed first, and the payload of a record that fails a
  predicate is passed over (uncompressed files: by a seek; gzip files, one
  member a record: inflated to find the member's end, but kept nowhere). The
  option ``payload=false`` passes over all payloads.
* Writing gives each task attempt files of its own in a folder of the job;
  they are moved into place when the job commits, so lost executors and
  retried tasks leave neither gaps nor repeats.

Files are opened through Arrow file systems (local, HDFS, object stores) in
the shared folder, never in a task's own folder.
"""

from __future__ import annotations

import gzip
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull,
    IsNull, StringStartsWith, WriterCommitMessage)

from .common import scratch, workers_can_import

HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To",
           "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest"}
SCHEMA = ("record_type string, record_id string, refers_to string, target_uri string, date string, "
          "payload_digest string, payload_length long, headers map<string,string>, payload binary")
ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_length", pa.int64()),
                   ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
# extension field: a revisit holds no payload, but its length is known
LENGTH_HEADER = "X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20
BATCH_RECORDS = 1000
CHUNK = 1 << 16


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", path))


# --- one record -----------------------------------------------------------

def _escaped(value: str) -> str:
    """Header text without line breaks or other control characters."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: quote(m[0], safe=""), value)


def record_bytes(row: dict) -> bytes:
    """A response (HTTP head and payload) or a revisit (HTTP head only)."""
    payload = row.get("payload") or b""
    length = row["payload_length"] if row.get("payload_length") is not None else len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload if row["record_type"] != "revisit" else b"")
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if row.get(column) is not None:
            value = _escaped(row[column])
            if column in ("record_id", "refers_to"):
                value = f"<urn:x-record:{value}>"
            elif column == "payload_digest":
                value = f"sha1:{value}"
            lines.append(f"{name}: {value}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"{LENGTH_HEADER}: {length}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if k}


def columns_of(headers: dict[str, str]) -> dict:
    lower = {k.lower(): v for k, v in headers.items()}
    row: dict = {}
    for column, name in HEADERS.items():
        value = lower.get(name.lower())
        if value is not None:
            if column in ("record_id", "refers_to"):
                value = re.sub(r"^<(?:urn:x-record:)?(.*)>$", r"\1", value, flags=re.S)
            elif column == "payload_digest":
                value = value.removeprefix("sha1:")
            value = unquote(value)
        row[column] = value
    length = lower.get(LENGTH_HEADER.lower())
    row["payload_length"] = int(length) if length is not None else None
    row["headers"] = list(headers.items())
    return row


def http_body(block: bytes, headers: dict[str, str]) -> bytes:
    if "application/http" in headers.get("Content-Type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


# --- reading --------------------------------------------------------------

@dataclass
class WarcFiles(InputPartition):
    files: tuple[str, ...]

    def __init__(self, files):
        super().__init__(tuple(files))
        self.files = tuple(files)


class _Plain:
    """Records of an uncompressed file: the body is read or skipped by a seek."""

    def __init__(self, stream):
        self.stream, self.buffer = stream, b""

    def head(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            more = self.stream.read(CHUNK)
            if not more:
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None
            self.buffer = (self.buffer + more).lstrip(b"\r\n")
        raw, self.buffer = self.buffer[:end], self.buffer[end + 4:]
        return raw

    def body(self, length: int, wanted: bool) -> bytes:
        have, rest = self.buffer[:length], length - len(self.buffer)
        self.buffer = self.buffer[length:]
        if rest > 0:
            if wanted:
                have += self.stream.read(rest)
            else:
                self.stream.seek(rest, 1)
        self.buffer = self.buffer.lstrip(b"\r\n")
        return have if wanted else b""


class _Gzip:
    """Records of a gzip file, one member each: inflated piece by piece; the
    rest of an unwanted record is inflated into nothing."""

    def __init__(self, stream):
        self.stream, self.raw = stream, b""
        self.member = None

    def _inflate(self, limit: int = 0) -> bytes:
        if not self.raw and not self.member.eof:
            self.raw = self.stream.read(CHUNK)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
        out = self.member.decompress(self.raw, limit)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return out

    def head(self) -> bytes | None:
        if not self.raw and not (more := self.stream.read(CHUNK)):
            return None
        elif not self.raw:
            self.raw = more
        self.member, self.buffer = zlib.decompressobj(31), b""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if self.member.eof:
                raise ValueError("a record without headers")
            self.buffer += self._inflate(1024)
        raw, self.buffer = self.buffer[:end], self.buffer[end + 4:]
        return raw

    def body(self, length: int, wanted: bool) -> bytes:
        parts = [self.buffer] if wanted else []
        while not self.member.eof:
            out = self._inflate(CHUNK)
            if wanted:
                parts.append(out)
        return b"".join(parts)[:length]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", 128 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            known = (EqualTo, EqualNullSafe, In, IsNotNull, IsNull, StringStartsWith)
            if isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            ok = {"IsNull": lambda: have is None, "IsNotNull": lambda: have is not None,
                  "EqualNullSafe": lambda: have == value,
                  "EqualTo": lambda: have is not None and have == value,
                  "In": lambda: have is not None and have in value,
                  "StringStartsWith": lambda: have is not None and have.startswith(value)}[kind]()
            if not ok:
                return False
        return True

    def partitions(self):
        fs, root = open_fs(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found
                       if f.type == pafs.FileType.File and "/_" not in f.path[len(root):]
                       and f.path.endswith((".warc", ".warc.gz")))
        parts, some, size = [], [], 0
        for path, n in files:
            if some and size + n > self.partition_bytes:
                parts.append(WarcFiles(some))
                some, size = [], 0
            some.append(path)
            size += n
        return [*parts, WarcFiles(some)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        rows, size = [], 0
        for path in partition.files:
            compressed = path.endswith(".gz")
            with (fs.open_input_stream(path, compression=None) if compressed else fs.open_input_file(path)) as stream:
                records = _Gzip(stream) if compressed else _Plain(stream)
                while (raw := records.head()) is not None:
                    headers = parse_headers(raw)
                    row = columns_of(headers)
                    wanted = self.wanted(row)
                    keep = wanted and self.with_payload and row["record_type"] != "revisit"
                    block = records.body(int(headers["Content-Length"]), keep)
                    if wanted:
                        row["payload"] = http_body(block, headers) if keep else None
                        rows.append(row)
                        size += len(block)
                    if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


# --- writing --------------------------------------------------------------

@dataclass
class WarcWritten(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.compressed = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("maxFileBytes", 1 << 30))
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, batches) -> WarcWritten:
        fs, root = open_fs(self.path)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        files, out = [], None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.file_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed
                        files.append(name)
                        out = fs.open_output_stream(f"{root}/{self.job}/{name}", compression=None)
                    raw = record_bytes(row)
                    out.write(gzip.compress(raw, 5, mtime=0) if self.compressed else raw)
        finally:
            if out is not None:
                out.close()
        return WarcWritten(tuple(files))

    def commit(self, messages) -> None:
        fs, root = open_fs(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                fs.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, root = open_fs(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Adds the format ``warc``. Spark passes predicates to Python data sources
    only under the setting below."""
    workers_can_import(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# --- pages ----------------------------------------------------------------

def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: ten hex digits at a time are forty bits,
    eight base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """WARC record columns of pages. Of equal payloads of ``least_bytes`` at
    least, the page with the smallest id is a response, the others revisit it;
    all shorter ones are responses.

    Rows that share the smallest id are all responses; a null id revisits the
    smallest id, or is a response where no row of its payload has one. Null
    html: empty payload.
    """
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("_id"), F.col(f"`{url}`").alias("target_uri"),
                        payload.alias("payload"))
    base = base.withColumns({"payload_digest": base32_sha1(F.col("payload")),
                             "payload_length": F.octet_length("payload").cast("long")})
    # counted first (pre-aggregated): only digests of several pages join. A hot
    # digest is one row here; the page side of the join can be split.
    first = base.where(F.col("payload_length") >= least_bytes).groupBy("payload_digest").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = base.join(first, "payload_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("record_id"),
        F.when(again, F.col("_first").cast("string")).alias("refers_to"), "target_uri",
        F.lit(date).alias("date"), "payload_digest", "payload_length",
        F.when(~again, F.col("payload")).alias("payload"))


def archived(pages: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Writes the pages as WARC files (to ``path``, or the shared folder) and
    returns the records read back."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch(spark, "warc")
    records(pages, **settings).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").load(path)
