"""WARC archives as a PySpark Python data source, with revisit records for repeated payloads.

Reading: an input partition is a file, or several where files are small for the number of tasks (``read_warc``
gives that); filters on record_type and on header columns are pushed down and decided
from a record's headers, and the block of a record that fails is stepped over without being read (in
uncompressed files) or decoded.  Without the option ``payload`` = true no payload is read at all, only the HTTP
header.  Writing: each task writes files of its own name, and the list of files of the tasks that committed is
written last, so files of lost or repeated attempts are never read.

``archive`` writes pages: of those with equal payloads of at least ``min_bytes`` bytes the one with the
smallest id (null last) is a response record and the others are revisit records that refer to it.

Null html is an empty payload, a null url leaves the header out, a null id stays null.  Pages that repeat with
the same id revisit the first of them.  Empty table: an archive without records.  Other columns are ignored.
A file that ends inside a record gives the records before it.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from tessera.llm._store import file_key, new_folder, quoted, small_batches, written

SCHEMA = "record_id string, record_type string, date string, target_uri string, payload_digest string, refers_to string, content_length long, payload_bytes long, payload binary"
#: Column to WARC header, for those that come straight from one.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
FILES = "_files.json"
BATCH_BYTES = 8 << 20
#: Most bytes of files that share a partition, and what opening a file counts as.
PART_BYTES, OPEN_BYTES = 128 << 20, 64 << 10


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri)


class FilePart(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class WarcSource(DataSource):
    """Options: path (file or folder), payload (true: read payloads), tasks (small files share so many partitions, or some more)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.tasks = int(options.get("tasks", "0"))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
                continue
            self.wanted.append((column, frozenset(f.value if isinstance(f, In) else [f.value])))

    def partitions(self) -> list[FilePart]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [FilePart([self.path])]
        base = self.path.rstrip("/")
        listed = f"{path.rstrip('/')}/{FILES}"
        if system.get_file_info(listed).type == fs.FileType.File:
            with system.open_input_stream(listed) as f:
                names = json.loads(f.read())
        else:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
            names = sorted(x.path[len(path.rstrip("/")) + 1 :] for x in found if x.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path))
        if not self.tasks or len(names) <= self.tasks:
            return [FilePart([f"{base}/{n}"]) for n in names]
        sizes = [(x.size or 0) + OPEN_BYTES for x in system.get_file_info([f"{path.rstrip('/')}/{n}" for n in names])]
        most = min(PART_BYTES, -(-sum(sizes) // self.tasks))
        parts: list[FilePart] = []
        weight = most
        for size, name in sorted(zip(sizes, names, strict=True), reverse=True):
            if weight + size > most:
                parts.append(FilePart([]))
                weight = 0
            parts[-1].uris.append(f"{base}/{name}")
            weight += size
        return parts

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        for uri in partition.uris if partition is not None else ():  # None: an archive without files
            yield from self._file(uri)

    def _file(self, uri: str) -> Iterator[pa.RecordBatch]:
        system, path = _open(uri)
        if path.endswith(".gz"):
            with system.open_input_stream(path, compression=None) as raw:
                yield from self._batches(gzip.GzipFile(fileobj=raw), None)
        else:
            with system.open_input_file(path) as raw:
                yield from self._batches(raw, raw.size())

    def _batches(self, file, size: int | None) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for record in self._records(file, size):
            held.append(record)
            weight += 500 + len(record[-1] or b"")
            if weight >= BATCH_BYTES:
                yield _batch(held)
                held, weight = [], 0
        if held:
            yield _batch(held)

    def _records(self, file, size: int | None) -> Iterator[tuple]:
        source = _Buffered(file, size)
        while True:
            line = source.line()
            while line in (b"\r\n", b"\n"):
                line = source.line()
            if not line.startswith(b"WARC/"):
                return
            headers = _headers(source)
            length = int(headers.get("content-length", 0))
            values = {c: headers.get(h) for c, h in HEADERS.items()}
            if any(values[c] not in allowed for c, allowed in self.wanted):
                if not source.skip(length):
                    return
                continue
            payload, payload_bytes = None, None
            if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
                begun = source.read_bytes
                source.line()
                inner = _headers(source)
                rest = length - (source.read_bytes - begun)
                payload_bytes = int(inner["content-length"]) if inner.get("content-length", "").isdigit() else rest
                if values["record_type"] != "revisit":
                    payload_bytes = rest
            else:
                rest = payload_bytes = length
            if self.payload and values["record_type"] != "revisit":
                payload = source.take(rest)
                if payload is None:
                    return
            elif not source.skip(rest):
                return
            yield (*values.values(), length, payload_bytes, payload)


class _Buffered:
    """Lines, bytes and skips over a file, by seeking where it can."""

    def __init__(self, file, size: int | None):
        self.file, self.size, self.buffer, self.at, self.read_bytes, self.place = file, size, b"", 0, 0, 0

    def _fill(self) -> bool:
        more = self.file.read(1 << 16)
        self.place += len(more)
        self.buffer = self.buffer[self.at :] + more
        self.at = 0
        return bool(more)

    def line(self) -> bytes:
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._fill():
                end = len(self.buffer) - 1
                break
        out = self.buffer[self.at : end + 1]
        self.at = end + 1
        self.read_bytes += len(out)
        return out

    def take(self, n: int) -> bytes | None:
        have = self.buffer[self.at : self.at + n]
        self.at += len(have)
        parts, left = [have], n - len(have)
        while left:
            more = self.file.read(left)
            if not more:
                return None
            self.place += len(more)
            parts.append(more)
            left -= len(more)
        return b"".join(parts)

    def skip(self, n: int) -> bool:
        inside = min(n, len(self.buffer) - self.at)
        self.at += inside
        n -= inside
        if not n:
            return True
        if self.size is not None:
            self.place += n
            self.file.seek(self.place)
            return self.place <= self.size
        while n:  # a packed record is inflated in pieces, none of which is kept
            more = self.file.read(min(n, 1 << 16))
            if not more:
                return False
            self.place += len(more)
            n -= len(more)
        return True


def _headers(source: _Buffered) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := source.line()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


_KINDS = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceWriter):
    """Writes rows of SCHEMA; payload_bytes is the full payload's length, also where the payload is left out."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.packed = options.get("compression", "gzip") == "gzip"  # each record a member of its own
        self.roll = int(options.get("rollbytes", str(256 << 20)))

    def write(self, rows: Iterator) -> Written:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for row in rows:
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.packed}")
                    out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = gzip.compress(record(row), 1) if self.packed else record(row)
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{FILES}") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list) -> None:
        system, path = _open(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{path}/{name}")


def record(row) -> bytes:
    payload = bytes(row["payload"] or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Refers-To", row["refers_to"])]
    if row["record_type"] == "revisit":
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        payload = b""
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "".join(f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in lines if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def _base32(digest):
    """The base-32 form of a hexadecimal SHA-1: each ten digits are eight of base 32, in another alphabet."""
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in range(1, 40, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", 2 * spark.sparkContext.defaultParallelism).load(path)


def archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes one record a page below ``path``; compression is gzip or none."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(quoted(pages, html_col).cast("string"), F.lit("")).cast("binary")
    key = file_key(pages)
    base = pages.select((F.monotonically_increasing_id() if key is None else key).alias("row"), quoted(pages, id_col).cast("long").alias("id"), quoted(pages, url_col).cast("string").alias("url"), html.alias("payload"))
    if key is None:  # numbers that must be the same in each of the scans below
        base = written(base, "pages")
    narrow = base.select("row", "id", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    # One row a payload, made before the shuffle where it can be; only payloads that repeat are joined back.
    first = narrow.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = narrow.join(first.select("digest", "first"), "digest").where("row <> first.row and n >= " + str(min_bytes)).select("row", F.struct("first.id", "first.row").alias("first"))
    name = lambda key, row: F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.concat(F.lit("none-"), row.cast("string"))), F.lit(">"))
    revisit = F.col("first").isNotNull()
    records = base.join(revisits, "row", "left").select(
        name(F.col("id"), F.col("row")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.lit(date).alias("date"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), _base32(F.sha1("payload"))).alias("payload_digest"),
        F.when(revisit, name(F.col("first.id"), F.col("first.row"))).alias("refers_to"),
        F.lit(0).cast("long").alias("content_length"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    spark.dataSource.register(WarcSource)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def page_of(column: str):
    """The page id in a record id, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(column, F.lit("")), "^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d),
b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS nibbles FROM f)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((nibbles[(g * 5) // 4 + 1] * 16 + coalesce(nibbles[(g * 5) // 4 + 2], 0)) // (1 << (3 - (g * 5) % 4)) % 32)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
