"""WARC archives as a Spark data source: written by the executors, read with planned splits and header predicates."""

from __future__ import annotations

import base64
import binascii
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
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

from gleanframe.llm.common import delete_at_exit, new_path

SCHEMA = ("record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
          "refers_to string, payload_length long, payload binary")
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                   ("content_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                   ("payload_length", pa.int64()), ("payload", pa.binary())])
#: Columns that a record's header decides, and the header they stand in.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest.json"
#: Bytes of an archive per read task, bytes of payload per batch, bytes taken from a file at a time, bytes unpacked at a time.
SPLIT, BATCH, CHUNK, UNPACK = 32 << 20, 8 << 20, 1 << 20, 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One record, not yet compressed. A revisit holds the HTTP header of the full answer and no payload."""
    payload = row["payload"] or b""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type'] or 'text/html'}\r\n"
            f"Content-Length: {row['payload_length'] if row['payload'] is None else len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["date"]),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode() if row["payload_digest"] else None),
            ("WARC-Refers-To", f"<{row['refers_to']}>" if row["refers_to"] else None),
            ("WARC-Profile", REVISIT_PROFILE if row["record_type"] == "revisit" else None),
            ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


class WrittenFile(WriterCommitMessage):
    def __init__(self, name: str, size: int, splits: list[int]):
        self.name, self.size, self.splits = name, size, splits


class WarcWriter(DataSourceArrowWriter):
    """A file per task, each record a gzip member, with an index of record offsets beside it. Only files that the commit lists in
    the manifest count, so what a lost task has left is never read."""

    def __init__(self, folder: str, level: int):
        self.folder, self.level = folder, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = _open(self.folder)
        fs.create_dir(folder)
        name = f"records-{uuid.uuid4().hex}.warc.gz"
        at, offsets, splits = 0, [], [0]
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for start in range(0, batch.num_rows, 64):
                    for row in batch.slice(start, 64).to_pylist():
                        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                        data = packer.compress(record_bytes(row)) + packer.flush()
                        if at - splits[-1] >= SPLIT:
                            splits.append(at)
                        offsets.append(at)
                        out.write(data)
                        at += len(data)
        with fs.open_output_stream(f"{folder}/{name}.index") as out:
            out.write(struct.pack(f"<{len(offsets)}Q", *offsets))
        return WrittenFile(name, at, splits)

    def commit(self, messages) -> None:
        fs, folder = _open(self.folder)
        fs.create_dir(folder)
        manifest = f"{folder}/{MANIFEST}"
        known = _manifest(fs, folder) or []
        known += [{"name": m.name, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.size]
        with fs.open_output_stream(manifest) as out:
            out.write(json.dumps(known).encode())

    def abort(self, messages) -> None:
        fs, folder = _open(self.folder)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.name}")
                fs.delete_file(f"{folder}/{m.name}.index")


def _manifest(fs: pafs.FileSystem, folder: str) -> list[dict] | None:
    if fs.get_file_info(f"{folder}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, indexed: bool):
        self.path, self.start, self.end, self.indexed = path, start, end, indexed


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def header_values(header: dict[str, str]) -> dict[str, str | None]:
    out = {column: header.get(name) for column, name in HEADERS.items()}
    for column in ("record_id", "refers_to"):
        if out[column]:
            out[column] = out[column].strip("<>")
    if out["payload_digest"]:
        value = out["payload_digest"].rpartition(":")[2]
        try:
            out["payload_digest"] = base64.b32decode(value).hex() if len(value) == 32 else value.lower()
        except binascii.Error:
            out["payload_digest"] = value.lower()
    return out


class _Stream:
    """Bytes of a file, taken in chunks; gzip members are unpacked only as far as somebody reads."""

    def __init__(self, file, packed: bool):
        self.file, self.packed, self.raw, self.ready = file, packed, b"", b""
        self.unpacker = zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        if not self.packed:
            data = self.file.read(CHUNK)
            self.ready += data
            return bool(data)
        while True:
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    return False
            data = self.unpacker.decompress(self.raw, UNPACK)
            self.raw = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if data:
                self.ready += data
                return True

    def until(self, end: bytes) -> bytes | None:
        while (at := self.ready.find(end)) < 0:
            if not self._more():
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(end) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        parts = []
        while n > 0 and (self.ready or self._more()):
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)


class WarcReader(DataSourceReader):
    """Plans splits of about SPLIT bytes at record boundaries where a manifest gives them, else a split per file."""

    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, StringStartsWith)):
                self.tests.append((column, "is" if isinstance(f, EqualTo) else "starts", f.value))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def wanted(self, values: dict[str, str | None]) -> bool:
        for column, test, wanted in self.tests:
            own = values[column]
            if own is None or test == "is" and own != wanted or test == "in" and own not in wanted or test == "starts" and not own.startswith(wanted):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [Split(path, 0, -1, False)]
        listed = _manifest(fs, path)
        if listed is not None:
            return [Split(f"{path}/{f['name']}", start, end, True) for f in listed for start, end in zip(f["splits"], [*f["splits"][1:], f["size"]])]
        files = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return [Split(f.path, 0, -1, False) for f in sorted(files, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for when there are no partitions
            return
        fs, _ = _open(self.path)
        rows, size = [], 0
        for row in self._indexed(fs, partition) if partition.indexed else self._whole(fs, partition):
            rows.append(row)
            size += 200 + len(row["payload"] or b"")
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _indexed(self, fs: pafs.FileSystem, split: Split) -> Iterator[dict]:
        with fs.open_input_stream(f"{split.path}.index") as f:
            packed = f.read()
        offsets = [x for x in struct.unpack(f"<{len(packed) // 8}Q", packed) if split.start <= x < split.end] + [split.end]
        with fs.open_input_file(split.path) as f:
            for start, end in zip(offsets, offsets[1:]):
                f.seek(start)
                row = self._record(_Stream(pa.BufferReader(f.read_buffer(end - start)), True))
                if row:
                    yield row

    def _whole(self, fs: pafs.FileSystem, split: Split) -> Iterator[dict]:
        with fs.open_input_file(split.path) as f:
            packed = f.read(2) == b"\x1f\x8b"
            f.seek(0)
            stream = _Stream(f, packed)
            while (row := self._record(stream, whole=True)) is not None:
                if row:
                    yield row

    def _record(self, stream: _Stream, whole: bool = False) -> dict | None:
        """The record, {} if it is not wanted, None at the end. Of an unwanted record the block is passed over: not even unpacked if an
        index says where the next one begins."""
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return None
        header = parse_header(head.lstrip(b"\r\n"))
        length = int(header.get("content-length", 0))
        values = header_values(header)
        if not self.wanted(values):
            if whole:
                stream.take(length + 4, False)
            return {}
        payload, full = None, None
        http = (values["content_type"] or "").startswith("application/http")
        block = stream.take(length, True) if self.payload or http else b""
        if not (self.payload or http) and whole:
            stream.take(length, False)
        if whole:
            stream.take(4, False)
        if http:
            answer, _, body = block.partition(b"\r\n\r\n")
            inner = parse_header(answer)
            values["content_type"] = inner.get("content-type")
            revisit = values["record_type"] == "revisit"
            full = int(inner.get("content-length", len(body))) if revisit else len(body)
            payload = None if revisit else body
        else:
            full, payload = length, block
        return values | {"payload_length": full, "payload": payload if self.payload else None}


class WarcSource(DataSource):
    """format("warc"): option path is a file or folder by URI; payload=false leaves payloads out; level is that of gzip."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options["path"], int(self.options.get("level", "4")))


def register(spark: SparkSession) -> None:
    """The pushdown of filters to Python data sources has to be switched on; the reader makes use of it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000,
            date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row to the folder: page_id in the record id, the html in UTF-8 as payload (null: empty).

    Of records with equal payloads (SHA-1) of at least `least` bytes, that with the largest id is a response and the others are revisits of it; smaller ones
    are all responses. Rows that repeat the largest id are responses each; a null id is smaller than any other and is written as an
    empty one. An empty table gives an empty archive. Other columns are not looked at.
    """
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    facts = own.select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).filter(F.col("n") >= least)
    best = facts.groupBy("digest").agg(F.max(F.struct("id")).alias("best"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    copies = facts.join(best, "digest").filter(~F.col("id").eqNullSafe(F.col("best.id"))).select(
        F.col("id").alias("rid"), F.col("digest").alias("rdigest"), F.col("best.id").cast("string").alias("first")).distinct()
    marked = own.withColumn("payload_digest", F.sha1("payload")).join(
        copies, F.col("id").eqNullSafe(F.col("rid")) & (F.col("payload_digest") == F.col("rdigest")), "left")
    urn = F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    marked.select(
        urn.alias("record_id"), F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit(date).alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), "payload_digest",
        F.concat(F.lit("urn:page:"), "first").alias("refers_to"), F.length("payload").cast("long").alias("payload_length"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive; filters on record_type and the other header columns reach the reader."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives the pages, reads the archives back: id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from the payload read; those of a revisit from its headers.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path, id_col, url_col, html_col)
    delete_at_exit(spark, path)
    kind = pages.schema[id_col].dataType
    page = lambda c: F.nullif(F.substring(c, 10, 1 << 20), F.lit("")).cast(kind)  # noqa: E731  what follows urn:page:
    revisit = F.col("record_type") == "revisit"
    return read(spark, path).select(
        page("record_id").alias(id_col), F.when(revisit, F.col("payload_length")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.sha1("payload")).alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"))
